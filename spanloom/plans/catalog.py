"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import evidence as V2
from spanloom.functions import intervals as I
from spanloom.functions import timeline as T
from spanloom.functions import vectors as V
from spanloom.operators import evaluation as E
from spanloom.operators import selection as S
from spanloom.plans import methods as M
from spanloom.sources import assets as A
from spanloom.sources import readers as R

START_US = 1704067200000000  # 2024-01-01 in microseconds
DURATION = 720.0


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hours() -> F.Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - START_US) / F.lit(3.6e9)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, start, end, score of clicks (predictions) and purchases (targets)."""
    e = _t(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    rows = e.select("user_id", "event_id", "event_type", _hours().alias("start"), F.least(F.lit(DURATION), _hours() + F.col("value") / 10).alias("end"), (F.col("value") / 500).alias("score"))
    return rows.where("`end` > start")


def _records(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """id, spans, targets, a row per user."""
    rows = _spans(spark, d)
    if most:
        rows = E.ranked(rows, ["user_id", "event_type"], ["start", "event_id"], most)
    item = F.struct("start", "end", "score")
    users = _t(spark, d, "events").select("user_id").distinct()
    got = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", item))).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", item))).alias("targets"),
    )
    none = F.array().cast(f"array<{I.SPAN}>")
    return users.join(got, "user_id", "left").select(F.col("user_id").alias("id"), F.coalesce("spans", none).alias("spans"), F.coalesce("targets", none).alias("targets"))


SPANS_SQL = """
s AS (SELECT user_id, event_id, event_type, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS a,
             least(720.0::DOUBLE, (epoch_us(ts) - 1704067200000000) / 3.6e9 + value / 10) AS b, value / 500 AS score
      FROM events WHERE event_type IN ('purchase', 'click')),
p AS (SELECT * FROM s WHERE event_type = 'click' AND b > a), t AS (SELECT * FROM s WHERE event_type = 'purchase' AND b > a)"""
IOU_SQL = """CASE WHEN greatest(p.b, t.b) - least(p.a, t.a) > 0 THEN greatest(0.0::DOUBLE, least(p.b, t.b) - greatest(p.a, t.a))
  / ((p.b - p.a) + (t.b - t.a) - greatest(0.0::DOUBLE, least(p.b, t.b) - greatest(p.a, t.a))) ELSE 0.0::DOUBLE END"""

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {SPANS_SQL}
SELECT p.user_id, p.event_id, round(coalesce(max({IOU_SQL}), 0.0), 6) AS best_iou FROM p LEFT JOIN t USING (user_id) GROUP BY 1, 2""")
def iou_best_window(spark, d):
    # only spans that overlap matter: they share a day; all others have 0
    days = F.explode(F.sequence(F.floor(F.col("start") / 24), F.floor(F.col("end") / 24))).alias("day")
    r = _spans(spark, d)
    p = r.where("event_type = 'click'")
    t = r.where("event_type = 'purchase'").select("user_id", days, F.struct("start", "end").alias("t"))
    j = p.select("user_id", "event_id", days, F.struct("start", "end").alias("p")).join(t, ["user_id", "day"])
    every = j.select("user_id", "event_id", I.iou(F.col("p"), F.col("t")).alias("v")).unionByName(p.select("user_id", "event_id", F.lit(0.0).alias("v")))
    return every.groupBy("user_id", "event_id").agg(F.round(F.max("v"), 6).alias("best_iou"))


@query(f"""WITH {SPANS_SQL}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY a, b, score) = 1),
v AS (SELECT t.user_id, coalesce(max({IOU_SQL.replace("p.", "f.")}), 0.0) AS v FROM t LEFT JOIN f USING (user_id) GROUP BY 1)
SELECT count(*) AS "count", round(avg(v), 6) AS miou, round(avg((v >= 0.3)::INT), 6) AS r1_3, round(avg((v >= 0.5)::INT), 6) AS r1_5, round(avg((v >= 0.7)::INT), 6) AS r1_7 FROM v""")
def single_span_eval(spark, d):
    s = E.single_summary(_records(spark, d))
    return s.select("count", F.round("miou", 6).alias("miou"), *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("r1_")])


UNION_SQL = f"""WITH {SPANS_SQL}, o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + %s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, score ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, round(min(a), 6) AS start_h, round(max(b), 6) AS end_h, round(max(score), 6) AS score FROM g GROUP BY user_id, g.g"""


def _merged(spark, d, gap):
    r = _records(spark, d).select(F.col("id").alias("user_id"), F.explode(I.merge(F.col("targets"), gap)).alias("s"))
    return r.select("user_id", F.round("s.start", 6).alias("start_h"), F.round("s.end", 6).alias("end_h"), F.round("s.score", 6).alias("score"))


@query(UNION_SQL % "0")
def interval_union(spark, d):
    return _merged(spark, d, 0.0)


@query(UNION_SQL % "3")
def gap_merge(spark, d):
    return _merged(spark, d, 3.0)


@query(f"""WITH {SPANS_SQL}, e AS (SELECT user_id, a AS x, 1 AS dp, 0 AS dt FROM p UNION ALL SELECT user_id, b, -1, 0 FROM p
  UNION ALL SELECT user_id, a, 0, 1 FROM t UNION ALL SELECT user_id, b, 0, -1 FROM t),
c AS (SELECT user_id, x, lead(x) OVER w - x AS len, sum(dp) OVER w2 AS np, sum(dt) OVER w2 AS nt FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY x), w2 AS (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING)),
u AS (SELECT user_id, sum(CASE WHEN np > 0 AND nt > 0 THEN len ELSE 0 END) AS i, sum(CASE WHEN np > 0 OR nt > 0 THEN len ELSE 0 END) AS u FROM c GROUP BY 1)
SELECT x.user_id, round(coalesce(CASE WHEN u.u > 0 THEN u.i / u.u END, 0.0), 5) AS t_iou FROM (SELECT DISTINCT user_id FROM events) x LEFT JOIN u USING (user_id)""")
def tiou_multi(spark, d):
    return _records(spark, d).select(F.col("id").alias("user_id"), F.round(I.set_iou(F.col("spans"), F.col("targets")), 5).alias("t_iou"))


@query(f"""WITH {SPANS_SQL} SELECT user_id, event_id, round(greatest(0.0, a), 6) AS start_h, round(least(360.0, b), 6) AS end_h FROM s WHERE b > a AND least(360.0, b) > greatest(0.0, a)""")
def clip_spans(spark, d):
    cut = _spans(spark, d).withColumn("c", F.explode(I.clip(F.array(I.span(F.col("start"), F.col("end"), F.col("score"))), F.lit(360.0))))
    return cut.select("user_id", "event_id", F.round("c.start", 6).alias("start_h"), F.round("c.end", 6).alias("end_h"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS start_s, l_quantity::INT::DOUBLE AS end_s, 1.0::DOUBLE AS score FROM lineitem WHERE l_quantity::INT > l_linenumber""")
def parse_spans_text(spark, d):
    li = _t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    text = F.when(F.col("l_orderkey") % 2 == 0, F.format_string("%d to %d", "l_linenumber", q)).otherwise(F.format_string("[[%d, %d]]", "l_linenumber", q))
    return li.select("l_orderkey", "l_linenumber", F.explode(I.parse_spans(text)).alias("s")).select("l_orderkey", "l_linenumber", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.score")


NMS_SQL = f"""WITH RECURSIVE {SPANS_SQL}, r AS (SELECT user_id, a, b, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, a, b) AS k FROM p),
f AS (SELECT user_id, 1::BIGINT AS k, [a] AS xs, [b] AS ys, true AS kept, a, b, score FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.k, CASE WHEN ok THEN list_append(f.xs, r.a) ELSE f.xs END, CASE WHEN ok THEN list_append(f.ys, r.b) ELSE f.ys END, ok, r.a, r.b, r.score
  FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1,
  LATERAL (SELECT NOT coalesce(list_bool_or(list_transform(list_zip(f.xs, f.ys), lambda z: greatest(0.0::DOUBLE, least(z[2], r.b) - greatest(z[1], r.a))
     > 0.3 * ((z[2] - z[1]) + (r.b - r.a) - greatest(0.0::DOUBLE, least(z[2], r.b) - greatest(z[1], r.a))))), false) AS ok) o)
SELECT user_id, round(a, 6) AS start_h, round(b, 6) AS end_h, round(score, 6) AS score FROM f WHERE kept"""


@query(NMS_SQL)
def temporal_nms(spark, d):
    r = _records(spark, d).select(F.col("id").alias("user_id"), F.explode(I.nms(F.col("spans"), 0.3)).alias("s"))
    return r.select("user_id", F.round("s.start", 6).alias("start_h"), F.round("s.end", 6).alias("end_h"), F.round("s.score", 6).alias("score"))


@query(NMS_SQL.partition("SELECT user_id, round(a, 6) AS start_h")[0].replace("> 0.3 *", "> 0.8 *") + """, k AS (SELECT user_id, a, b, score FROM f WHERE kept),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, score ROWS UNBOUNDED PRECEDING) AS g FROM o),
z AS (SELECT user_id, min(a) AS a, max(b) AS b, max(score) AS score FROM g GROUP BY user_id, g.g)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, a, b) - 1)::INT AS rank, round(a, 6) AS start_h, round(b, 6) AS end_h, round(score, 6) AS score FROM z""")
def consolidate(spark, d):
    r = _records(spark, d).select(F.col("id").alias("user_id"), F.posexplode(I.consolidate(F.col("spans"), F.lit(DURATION))).alias("rank", "s"))
    return r.select("user_id", "rank", F.round("s.start", 6).alias("start_h"), F.round("s.end", 6).alias("end_h"), F.round("s.score", 6).alias("score"))


@query()
def assignment_metrics(spark, d):
    m = E.multi_summary(_records(spark, d))
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query(f"""WITH {SPANS_SQL},
pr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS k FROM p), tr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS k FROM t),
m AS (SELECT p.user_id, p.k AS i, t.k AS j, {IOU_SQL} AS v FROM pr p JOIN tr t ON p.user_id = t.user_id WHERE p.k <= 3 AND t.k <= 3),
z AS (SELECT user_id, sum(CASE WHEN i = 1 AND j = x OR i = 2 AND j = y OR i = 3 AND j = z THEN v ELSE 0 END) AS total
      FROM m, (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) q(x, y, z) GROUP BY user_id, x, y, z)
SELECT user_id, round(max(total), 6) AS total FROM z GROUP BY user_id""")
def assignment_small(spark, d):
    """The best one-to-one matching of three spans with three, by its sum."""
    r = E.matched(_records(spark, d, 3).where((F.size("spans") > 0) & (F.size("targets") > 0)))
    return r.select(F.col("id").alias("user_id"), F.round(F.aggregate("matched", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT o_orderkey, i, round(least(dur - 1e-4, (i + 0.5) * (dur / n)), 9) AS ts FROM (SELECT o_orderkey, o_totalprice / 1000 AS dur, (o_orderkey % 7)::INT AS n FROM orders),
LATERAL (SELECT unnest(range(0, n)) AS i) WHERE dur > 0""")
def uniform_timestamps(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("dur"), (F.col("o_orderkey") % 7).cast("int").alias("n"))
    return o.select("o_orderkey", F.posexplode(T.uniform_timestamps(F.lit(0.0), F.col("dur"), F.col("n"))).alias("i", "ts")).select("o_orderkey", F.col("i").cast("long").alias("i"), F.round("ts", 9).alias("ts"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS dur FROM orders), n AS (SELECT *, greatest(0, floor((dur - 65) / 41)::INT + 1) AS last FROM o)
SELECT o_orderkey, i, round(i * 41.0, 6) AS start_s, round(CASE WHEN i = last THEN dur ELSE i * 41.0 + 45 END, 6) AS end_s FROM n, LATERAL (SELECT unnest(range(0, last + 1)) AS i) WHERE dur > 0""")
def uniform_windows(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.posexplode(T.uniform_windows(F.col("o_totalprice") / 100)).alias("i", "w"))
    return o.select("o_orderkey", F.col("i").cast("long").alias("i"), F.round("w.start", 6).alias("start_s"), F.round("w.end", 6).alias("end_s"))


@query("""WITH n AS (SELECT unnest(range(2, 121))::INT AS n),
f AS (SELECT n, max(m) AS feasible FROM n, LATERAL (SELECT unnest(range(2, n + 1))::INT AS m) WHERE m * (1 + m % 2) + 2 * least(m, 8, greatest(2, ceil(sqrt(m))::INT)) <= 64 GROUP BY n),
k AS (SELECT n, feasible, least(feasible, 8, greatest(2, ceil(sqrt(feasible))::INT)) AS kept FROM f)
SELECT n, feasible, kept, max(v)::INT AS router, (64 - max(v) * feasible)::INT AS local FROM k, (VALUES (1), (2), (3), (4)) t(v) WHERE v * feasible % 2 = 0 AND v * feasible + 2 * kept <= 64 GROUP BY n, feasible, kept""")
def budget_policy(spark, d):
    return T.budget_table(spark, 120).select("n", "feasible", "kept", "router", "local")


@query("""SELECT n, i AS rank, 2 * ((64 - n) // 2 // n + CASE WHEN i < (64 - n) // 2 % n THEN 1 ELSE 0 END)::INT AS frames FROM (SELECT unnest(range(2, 17))::INT AS n), LATERAL (SELECT unnest(range(0, n))::INT AS i)""")
def frame_allocation(spark, d):
    return spark.createDataFrame([(n, i, x) for n in range(2, 17) for i, x in enumerate(T.distribute(64 - n, n))], "n int, rank int, frames int")


@query("""WITH RECURSIVE u AS (SELECT user_id, list_concat([0.0::DOUBLE, 720.0::DOUBLE], list(least(720.0::DOUBLE, greatest(0.0::DOUBLE, (epoch_us(ts) - 1704067200000000) / 3.6e9)))) AS pts FROM events GROUP BY 1),
r AS (SELECT user_id, pts, -1 AS i, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e FROM u
  UNION ALL SELECT user_id, pts, i + 1, greatest(CASE WHEN i = -1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, e - 2) END, ne - 60), ne
  FROM (SELECT *, CASE WHEN 720 - x < 20 THEN 720.0::DOUBLE ELSE x END AS ne
        FROM (SELECT *, least(720.0::DOUBLE, coalesce(list_max(list_filter(pts, lambda p: p >= e + 20 AND p <= e + 60)), e + 45)) AS x FROM r WHERE e < 720 - 1e-6)))
SELECT user_id, i::INT AS i, round(s, 6) AS start_h, round(e, 6) AS end_h FROM r WHERE i >= 0""")
def boundary_windows(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(_hours())).alias("b"))
    return e.select("user_id", F.posexplode(T.windows_from_boundaries(F.lit(DURATION), F.col("b"))).alias("i", "w")).select("user_id", "i", F.round("w.start", 6).alias("start_h"), F.round("w.end", 6).alias("end_h"))


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, event_id FROM events),
n AS (SELECT *, ntile(8) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM e)
SELECT user_id, (g - 1)::INT AS i, round(min(t), 6) AS start_h, round(max(t) + 1, 6) AS end_h FROM n GROUP BY user_id, g""")
def coalesce_windows(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(_hours().alias("t"), "event_id"))).alias("e"))
    w = F.transform("e", lambda x: T.window(x["t"], x["t"] + 1))
    return e.select("user_id", F.posexplode(T.coalesce_windows(w, F.lit(8))).alias("i", "w")).select("user_id", "i", F.round("w.start", 6).alias("start_h"), F.round("w.end", 6).alias("end_h"))


def _evidence(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("id"), F.col("embedding").cast("array<double>").alias("emb"))
    q = e.groupBy(((F.col("id") + 9) % 10).alias("id")).agg(F.min_by("emb", "vec_id").alias("q"))
    w = Window.partitionBy("id").orderBy("vec_id")
    return e.withColumn("idx", F.row_number().over(w) - 1).withColumn("ts", 0.5 * F.col("idx")).join(q, "id").withColumn("score", V.dot(F.col("emb"), F.col("q")))


EVIDENCE_SQL = """e AS (SELECT vec_id, label::INT AS id, embedding::DOUBLE[] AS emb FROM embeddings),
q AS (SELECT (id + 9) % 10 AS id, arg_min(emb, vec_id) AS q FROM e GROUP BY 1),
v AS (SELECT e.id, vec_id, row_number() OVER (PARTITION BY e.id ORDER BY vec_id) - 1 AS idx, list_dot_product(emb, q.q) AS score FROM e JOIN q ON q.id = e.id)"""


@query(f"WITH {EVIDENCE_SQL} SELECT id, vec_id, round(idx * 0.5, 6) AS ts, round(score, 5) AS score FROM v")
def query_scores(spark, d):
    return _evidence(spark, d).select("id", "vec_id", F.round("ts", 6).alias("ts"), F.round("score", 5).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS emb FROM embeddings), q AS (SELECT emb AS t FROM e ORDER BY vec_id LIMIT 8)
SELECT vec_id, round(max(list_cosine_similarity(emb, t)), 5) AS maxsim FROM e, q GROUP BY vec_id""")
def maxsim(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("emb"))
    tokens = e.orderBy("vec_id").limit(8).agg(F.collect_list("emb").alias("tokens"))  # a query has a fixed number of tokens
    rows = e.join(F.broadcast(tokens))
    return rows.select("vec_id", F.round(F.array_max(F.transform("tokens", lambda t: V.cosine(F.col("emb"), t))), 5).alias("maxsim"))


@query("""SELECT label::INT AS label, i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2""")
def sentence_pool(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("label").cast("int").alias("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 5).alias("mean"))


@query(f"""WITH {EVIDENCE_SQL}, m AS (SELECT id, floor(idx / 2) AS ts, max((round(score, 9), idx)) AS m FROM v GROUP BY 1, 2)
SELECT id, ts::DOUBLE AS ts, round(m[1], 5) AS score, m[2]::BIGINT AS idx FROM m""")
def temporal_scores(spark, d):
    r = _evidence(spark, d).select("id", "idx", F.floor(F.col("idx") / 2).cast("double").alias("ts"), F.round("score", 9).alias("score"))
    return S.temporal_scores(r).select("id", "ts", F.round("score", 5).alias("score"), F.col("idx").cast("long").alias("idx"))


def _corridors(spark, d):
    r = _evidence(spark, d).groupBy("id").agg(F.collect_list(F.struct(F.col("ts").alias("t"), F.round("score", 9).alias("score"))).alias("s"), (F.max("ts") + 0.5).alias("duration"))
    return r.select("id", "duration", F.posexplode(T.corridors(F.col("s"), F.col("duration"), 3)).alias("corridor", "c")).select("id", "duration", "corridor", F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"), "c.score")


CORRIDORS_SQL = f"""RECURSIVE {EVIDENCE_SQL}, c AS (SELECT id, idx * 0.5 AS t, round(score, 9) AS score FROM v),
du AS (SELECT id, max(t) + 0.5 AS dur FROM c GROUP BY 1),
o AS (SELECT c.*, dur, row_number() OVER (PARTITION BY c.id ORDER BY score DESC, t) AS k FROM c JOIN du USING (id)),
f AS (SELECT id, dur, k, [t]::DOUBLE[] AS ts, true AS kept, t, score FROM o WHERE k = 1
  UNION ALL SELECT o.id, o.dur, o.k, CASE WHEN ok THEN list_append(f.ts, o.t::DOUBLE) ELSE f.ts END, ok, o.t, o.score
  FROM f JOIN o ON o.id = f.id AND o.k = f.k + 1,
  LATERAL (SELECT len(f.ts) < 3 AND NOT coalesce(list_bool_or(list_transform(f.ts, lambda p: abs(p - o.t) < least(8.0, greatest(4.0, o.dur / 6)))), false) AS ok) x),
h AS (SELECT id, dur, score, least(dur, t + least(64.0, greatest(16.0, dur / 8))) AS b, least(64.0, greatest(16.0, dur / 8)) AS half FROM f WHERE kept),
cor AS (SELECT id, dur, greatest(0.0, b - 2 * half)::DOUBLE AS c_start, b::DOUBLE AS c_end, score, (row_number() OVER (PARTITION BY id ORDER BY greatest(0.0, b - 2 * half), b, score) - 1)::INT AS corridor FROM h)"""


@query(f"WITH {CORRIDORS_SQL} SELECT id, corridor, round(c_start, 6) AS c_start, round(c_end, 6) AS c_end, round(score, 5) AS score FROM cor")
def corridors(spark, d):
    return _corridors(spark, d).select("id", "corridor", F.round("c_start", 6).alias("c_start"), F.round("c_end", 6).alias("c_end"), F.round("score", 5).alias("score"))


@query(f"""WITH {CORRIDORS_SQL},
i AS (SELECT cor.id, corridor, dur, c_start, c_end, v.idx * 0.5 AS ts, v.score FROM cor LEFT JOIN v ON v.id = cor.id AND v.idx * 0.5 BETWEEN c_start AND c_end),
w AS (SELECT *, score - lag(score) OVER q AS rise, score - lead(score) OVER q AS fall FROM i WINDOW q AS (PARTITION BY id, corridor ORDER BY ts)),
b AS (SELECT id, corridor, dur, c_start, c_end, count(ts) AS n, max((rise, -ts)) FILTER (WHERE rise IS NOT NULL) AS up, max((fall, ts)) FILTER (WHERE fall IS NOT NULL) AS down FROM w GROUP BY ALL),
ends AS (SELECT id, dur, CASE WHEN n < 2 THEN c_start ELSE -up[2] END AS c, 'start' AS role, CASE WHEN n < 2 THEN 0.0 ELSE up[1] END AS score FROM b
  UNION ALL SELECT id, dur, CASE WHEN n < 2 THEN c_end ELSE down[2] END, 'end', CASE WHEN n < 2 THEN 0.0 ELSE down[1] END FROM b)
SELECT id, round(greatest(0.0, c - 2), 6)::DOUBLE AS start_s, round(least(dur, c + 2), 6)::DOUBLE AS end_s, role, round(score, 5) AS score FROM ends WHERE least(dur, c + 2) > greatest(0.0, c - 2)""")
def boundary_bands(spark, d):
    b = S.boundary_bands(_evidence(spark, d).select("id", "ts", "score"), _corridors(spark, d).drop("score"))
    return b.select("id", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "role", F.round("score", 5).alias("score"))


@query(f"""WITH {SPANS_SQL}, n AS (SELECT user_id, event_id, a, b, greatest(2, ceil((b - a) * 0.5)::INT) AS n FROM p),
x AS (SELECT user_id, event_id, least(b - 1e-4, a + (i + 0.5) * ((b - a) / n)) AS t FROM n, LATERAL (SELECT unnest(range(0, n)) AS i))
SELECT user_id, count(DISTINCT round_even(t, 6)) AS n, round(min(t), 5) AS first_h, round(max(t), 5) AS last_h FROM x GROUP BY 1""")
def observation_timestamps(spark, d):
    w = _spans(spark, d).where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("event_id").alias("win"), "start", "end", F.lit("content").alias("role"))
    return S.observations(w, 0.5, pad=False).groupBy(F.col("id").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.min("ts"), 5).alias("first_h"), F.round(F.max("ts"), 5).alias("last_h"))


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, (event_type <> 'click')::INT AS pass FROM events WHERE event_type IN ('click', 'view'))
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, pass, event_id) AS pos FROM e""")
def evidence_union(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("idx"), _hours().alias("ts"), "event_type")
    u = S.concatenated(e.where("event_type = 'click'"), e.where("event_type = 'view'"))
    return u.select(F.col("id").alias("user_id"), F.col("idx").alias("event_id"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {EVIDENCE_SQL} SELECT id, vec_id, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, idx) AS rank FROM v QUALIFY rank <= 5")
def topk_windows(spark, d):
    r = _evidence(spark, d).withColumn("score", F.round("score", 9))
    return E.ranked(r, ["id"], [F.desc("score"), "idx"], 5).select("id", "vec_id", F.col("rank").cast("long").alias("rank"))


COVERAGE_SQL = """t AS (SELECT *, min(ts) OVER (PARTITION BY id) AS t0, max(ts) OVER (PARTITION BY id) AS t1, {goal} AS goal FROM rows),
b AS (SELECT *, greatest(1, ceil(sqrt(goal)))::INT AS bands, least(greatest(1, ceil(sqrt(goal)))::INT - 1, floor((ts - t0) / ((t1 - t0 + 1e-6) / greatest(1, ceil(sqrt(goal)))::INT))::INT) AS band FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY id, band ORDER BY score DESC, idx) AS ib, row_number() OVER (PARTITION BY id, ts ORDER BY score DESC, idx) AS it, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS o FROM b),
chosen AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN ib = 1 OR it = 1 AND (ts = t0 OR ts = t1) THEN 0 ELSE 1 END, o) <= goal)"""


@query(f"""WITH {EVIDENCE_SQL}, rows AS (SELECT id, idx, (idx * 0.5)::DOUBLE AS ts, round(score, 9) AS score FROM v), {COVERAGE_SQL.format(goal="12")}
SELECT id, idx, ts FROM chosen""")
def timeline_coverage_topk(spark, d):
    return S.coverage_topk(_evidence(spark, d).select("id", F.col("idx").cast("long").alias("idx"), "ts", F.round("score", 9).alias("score")), 12).select("id", "idx", "ts")


@query()
def diverse_pack(spark, d):
    r = _evidence(spark, d).select("id", F.col("idx").cast("long").alias("idx"), "ts", "score", "emb", (F.col("idx") % 20 == 0).alias("anchor"))
    return S.diverse_pack(r, 12)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, d):
    return E.pending(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_fill_empty(spark, d):
    log = _t(spark, d, "labels").withColumn("at", F.lit(0))
    r = _t(spark, d, "documents").select("doc_id").join(E.last_wins(log, "doc_id", "at"), "doc_id", "left")
    return r.select("doc_id", F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("quality"))


@query("""SELECT count(*) AS requested, count(l.doc_id) AS successful, count(*) - count(l.doc_id) AS failed,
CASE WHEN count(*) = 0 THEN 'empty' WHEN count(l.doc_id) = 0 THEN 'failed' WHEN count(*) > count(l.doc_id) THEN 'partial' ELSE 'complete' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def run_summary(spark, d):
    return E.run_summary(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query()
def seeded_subset(spark, d):
    return S.seeded_subset(spark, _t(spark, d, "documents").select("doc_id"), "doc_id", 7, 12.5)


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'rgb_videos_30fps_480' WHEN 1 THEN 'videos' ELSE 'other' END AS folder, CASE page_id % 4 WHEN 0 THEN 'avi' WHEN 1 THEN 'mp4' WHEN 2 THEN 'webm' ELSE 'txt' END AS suffix,
  CASE WHEN page_id % 2 = 0 THEN 's' || (page_id % 17) || '-d' || (page_id % 5) || '-cam-00' || (page_id % 7) ELSE 'clip' || (page_id % 19) END AS stem FROM pages),
f AS (SELECT *, '/r/' || folder || '/' || stem || '.' || suffix AS path FROM p WHERE folder <> 'other' AND suffix <> 'txt'),
n AS (SELECT stem, folder, suffix, path FROM f UNION ALL SELECT regexp_extract(stem, '^(s\d+-d\d+)-cam-\d+$', 1), folder, suffix, path FROM f WHERE regexp_matches(stem, '^s\d+-d\d+-cam-\d+$'))
SELECT stem, arg_min(path, ((CASE folder WHEN 'videos' THEN 0 ELSE 1 END), list_position(['mp4', 'mkv', 'webm', 'avi'], suffix), path)) AS path FROM n GROUP BY stem""")
def video_catalog_dedupe(spark, d):
    """The catalog of files with several names, folders and suffixes, made from the pages' numbers."""
    i = F.col("page_id")
    folder = F.when(i % 3 == 0, "rgb_videos_30fps_480").when(i % 3 == 1, "videos").otherwise("other")
    suffix = F.when(i % 4 == 0, "avi").when(i % 4 == 1, "mp4").when(i % 4 == 2, "webm").otherwise("txt")
    stem = F.when(i % 2 == 0, F.concat(F.lit("s"), i % 17, F.lit("-d"), i % 5, F.lit("-cam-00"), i % 7)).otherwise(F.concat(F.lit("clip"), i % 19))
    return R.video_catalog(_t(spark, d, "pages").select(F.concat(F.lit("/r/"), folder, F.lit("/"), stem, F.lit("."), suffix).alias("path")), "/r")


@query("""SELECT DISTINCT doc_id::VARCHAR AS video, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 > 0)
UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'unexpected' FROM labels WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_differences(spark, d):
    """What annotations name and files lack, and the other way round."""
    expected = A.normal_ids(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("vid")))
    files = _t(spark, d, "labels").where("doc_id % 3 > 0").select(F.concat(F.lit("/v/"), "doc_id", F.lit(".mp4")).alias("path"))
    return A.difference(expected, A.present_ids(files))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS dur, (o_orderkey % 7 + 1)::INT AS n FROM orders),
r AS (SELECT o_orderkey, i, n, least(1.0, greatest(0.0, (least(dur - 1e-4, (i + 0.5) * (dur / n)) - dur / 4) / (dur / 2))) AS r FROM o, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE dur > 0)
SELECT o_orderkey, i::INT AS i, round(r, 9) AS relative, round(least(1.0, greatest(0.0, r - 0.5 / n)), 9) AS share_start, round(least(1.0, greatest(0.0, r + 0.5 / n)), 9) AS share_end FROM r""")
def endpoint_features(spark, d):
    """Rows' places in the middle half of a timeline, and the ends of their shares of it."""
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("dur"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("n")).where("dur > 0")
    o = o.withColumn("r", V2.relative(T.uniform_timestamps(F.lit(0.0), F.col("dur"), F.col("n")), F.col("dur") / 4, F.col("dur") * 3 / 4))
    o = o.select("o_orderkey", F.posexplode(F.arrays_zip("r", V2.endpoint_features(F.col("r")).alias("e"))).alias("i", "z"))
    return o.select("o_orderkey", "i", F.round("z.r", 9).alias("relative"), F.round("z.e.start", 9).alias("share_start"), F.round("z.e.end", 9).alias("share_end"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS r, l_discount - 0.05 AS a, l_tax - 0.02 AS b, l_extendedprice AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(10 + least(1.0, greatest(0.0, r + a)) * 30, 6) AS start_s, round(10 + least(1.0, greatest(0.0, r + b)) * 30, 6) AS end_s, s AS score FROM l WHERE b > a""")
def dense_proposals(spark, d):
    """A span for each row and its offsets, in absolute time."""
    li = _t(spark, d, "lineitem")
    off = F.array(F.struct((F.col("l_discount") - 0.05).alias("start"), (F.col("l_tax") - 0.02).alias("end")))
    spans = V2.dense_proposals(F.array(F.col("l_quantity") / 50), off, F.array("l_extendedprice"), F.lit(10.0), F.lit(40.0))
    r = li.select("l_orderkey", "l_linenumber", F.explode(spans).alias("s"))
    return r.select("l_orderkey", "l_linenumber", F.round("s.start", 6).alias("start_s"), F.round("s.end", 6).alias("end_s"), "s.score")


@query("""WITH g AS (SELECT p_partkey, (p_partkey % 3 + 1)::INT AS t, (2 * (p_size % 9))::INT AS h, (2 * (p_partkey % 11))::INT AS w FROM part),
c AS (SELECT p_partkey, t, h, w, f, r, c, i FROM g, LATERAL (SELECT unnest(range(0, t)) AS f), LATERAL (SELECT unnest(range(0, h // 2, 2)) AS r), LATERAL (SELECT unnest(range(0, w // 2, 2)) AS c), LATERAL (SELECT unnest(range(0, 4)) AS i))
SELECT g.p_partkey, count(i) AS tokens, coalesce(sum(f * g.h * g.w + (r * (g.w // 2) + c) * 4 + i), 0)::BIGINT AS total, (2 * ((g.h // 2 + 1) // 2))::INT AS rows, (2 * ((g.w // 2 + 1) // 2))::INT AS columns
FROM g LEFT JOIN c ON c.p_partkey = g.p_partkey GROUP BY g.p_partkey, g.h, g.w""")
def pruned_grids(spark, d):
    """Tokens and grids that are left when every other row and column of cells goes."""
    tokens, grid = V2.pruned_grid(F.col("t"), F.col("h"), F.col("w"), 2, 0.25)
    g = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3 + 1).cast("int").alias("t"), (2 * (F.col("p_size") % 9)).cast("int").alias("h"), (2 * (F.col("p_partkey") % 11)).cast("int").alias("w"))
    g = g.select("p_partkey", tokens.alias("k"), grid.alias("g"))
    total = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x)
    return g.select("p_partkey", F.size("k").cast("long").alias("tokens"), total.alias("total"), F.col("g")[1].alias("rows"), F.col("g")[2].alias("columns"))


@query("""WITH x AS (SELECT n, u, i, round_even(i * n / u, 0)::INT AS a, round_even((i + 1) * n / u, 0)::INT AS b FROM (SELECT unnest(range(1, 13))::INT AS n) a, (SELECT unnest(range(1, 9))::INT AS u) b, LATERAL (SELECT unnest(range(0, u))::INT AS i)),
t AS (SELECT n, u, i, least(a, n - 1) AS a, least(n, least(a, n - 1) + greatest(1, b - a)) AS b FROM x)
SELECT n, u, i, round(avg(k * 1.5), 6) AS centre FROM t, LATERAL (SELECT unnest(range(a, b)) AS k) GROUP BY n, u, i""")
def tubelet_times(spark, d):
    """Mean times of grouped frames, for all small numbers of frames and groups."""
    n = spark.range(1, 13).crossJoin(spark.range(1, 9).withColumnRenamed("id", "u"))  # a grid of parameters
    n = n.select(F.col("id").cast("int").alias("n"), F.col("u").cast("int").alias("u"))
    times = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k * 1.5)
    return n.select("n", "u", F.posexplode(V2.tubelet_times(times, F.col("u"), F.lit(1))).alias("i", "c")).select("n", "u", "i", F.round("c", 6).alias("centre"))


@query("""WITH p AS (SELECT unnest([0.0, 0.00001, 0.5, 12.5, 17.6, 33.333333, 100.0])::DOUBLE AS percent), n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT percent, n, rtrim(rtrim(printf('%.6f', percent), '0'), '.') AS s FROM p, n)
SELECT percent, 'p' || lpad(split_part(s, '.', 1), 3, '0') || CASE WHEN contains(s, '.') THEN '.' || split_part(s, '.', 2) ELSE '' END AS key, ceil(n * percent / 100)::BIGINT AS size FROM f""")
def subset_sizes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    rows = [(p, S.percent_key(p), S.seeded_subset(spark, docs, "doc_id", 3, p).count()) for p in (0.0, 0.00001, 0.5, 12.5, 17.6, 33.333333, 100.0)]
    return spark.createDataFrame(rows, "percent double, key string, size long")


@query("""WITH b AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS win, o_orderkey % 50 AS s, o_orderkey % 50 + o_orderkey % 9 AS e, o_orderstatus AS role FROM orders),
r AS (SELECT c_custkey AS id, (c_custkey * 7 + k * 11) % 60 AS ts FROM customer, (SELECT unnest(range(0, 4)) AS k) x)
SELECT r.id, r.ts::DOUBLE AS ts, coalesce(arg_min(b.role, b.win) FILTER (WHERE b.s <= r.ts AND r.ts <= b.e), 'boundary') AS role, count(DISTINCT r.ts) AS n FROM r LEFT JOIN b ON b.id = r.id GROUP BY r.id, r.ts""")
def first_bands(spark, d):
    """The role of the first band that holds a time."""
    o = _t(spark, d, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    start = F.col("o_orderkey") % 50
    b = o.select(F.col("o_custkey").alias("id"), number.alias("win"), start.cast("double").alias("start"), (start + F.col("o_orderkey") % 9).cast("double").alias("end"), F.col("o_orderstatus").alias("role"))
    r = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    r = r.select("id", ((F.col("id") * 7 + F.col("k") * 11) % 60).cast("double").alias("ts")).distinct()
    return S.first_band(r, b).select("id", "ts", "role", F.lit(1).cast("long").alias("n"))


@query(f"""WITH {EVIDENCE_SQL}, m AS (SELECT id, idx, idx // 3 * 0.5 AS ts, round(score, 9) AS score FROM v), s AS (SELECT id, ts, count(*) AS n FROM m WHERE idx % 3 < 2 AND (idx // 3) % 4 = 0 GROUP BY 1, 2),
c AS (SELECT m.*, s.n FROM m JOIN s ON s.id = m.id AND abs(m.ts - s.ts) < 1e-5 QUALIFY row_number() OVER (PARTITION BY m.id, m.ts ORDER BY m.idx) <= s.n)
SELECT id, idx FROM c QUALIFY row_number() OVER (PARTITION BY id, ts ORDER BY score DESC, idx) = 1""")
def scout_anchors(spark, d):
    """The best of a scout pass's rows at each of its times, among merged evidence."""
    m = _evidence(spark, d).select("id", F.col("idx").cast("long").alias("idx"), (F.floor(F.col("idx") / 3) * 0.5).alias("ts"), F.round("score", 9).alias("score"))
    scout = m.where((F.col("idx") % 3 < 2) & (F.floor(F.col("idx") / 3) % 4 == 0)).select("id", "ts")
    return S.scout_anchors(m, scout).where("anchor").select("id", "idx")


@query("""SELECT (o_totalprice >= 50000)::INT + (o_totalprice >= 150000)::INT + (o_totalprice >= 300000)::INT AS stratum, count(*) AS "count", round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1""")
def strata_means(spark, d):
    return E.strata(_t(spark, d, "orders"), "o_totalprice", [50000.0, 150000.0, 300000.0], "o_totalprice").select("stratum", "count", F.round("mean", 2).alias("mean"))


def _samples(spark, d):
    """One sample per user, as long as the events' thirty days have hours; even users look for several occurrences."""
    u = _t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("query"))
    return u.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("v"), F.col("user_id")).alias("video"), F.lit(DURATION).alias("duration"), "query", F.when(F.col("user_id") % 2 == 0, "multi").otherwise("single").alias("cardinality"))


def _answers(got):
    p = got.select("id", F.posexplode("spans").alias("rank", "s"))
    return p.select("id", "rank", F.round("s.start", 4).alias("start_s"), F.round("s.end", 4).alias("end_s"), F.round("s.score", 6).alias("score"))


TALLY_SQL = "((floor({ts} * 2)::BIGINT * 7919 + id::BIGINT * 104729) % 1009) / 1009.0"


@query(f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events),
rows AS (SELECT id, i AS idx, ts, {TALLY_SQL.format(ts="ts")} AS score FROM (SELECT id, i, least(720 - 1e-4, (i + 0.5) * (720.0::DOUBLE / 768)) AS ts FROM u, LATERAL (SELECT unnest(range(0, 768)) AS i))), {COVERAGE_SQL.format(goal="90")}
SELECT id::VARCHAR AS id, 0 AS rank, round(min(ts), 4) AS start_s, round(max(ts), 4) AS end_s, round(avg(score), 6) AS score FROM chosen GROUP BY 1""")
def method_coverage_query(spark, d):
    return _answers(M.coverage_query(_samples(spark, d), M.Tally(limit=90)))


@query(f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events),
w AS (SELECT id, i AS win, i * 41.0 AS a, CASE WHEN i = 16 THEN 720.0 ELSE i * 41.0 + 45 END AS b FROM u, LATERAL (SELECT unnest(range(0, 17)) AS i)),
x AS (SELECT id, win, a, b, max({TALLY_SQL.format(ts="(a + (k + 0.5) * ((b - a) / 2))")}) AS s FROM w, (VALUES (0), (1)) q(k) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, win) AS r FROM x QUALIFY r <= 5),
l AS (SELECT id, win, r, ts, {TALLY_SQL.format(ts="ts")} AS score FROM (SELECT id, win, r, a + (k + 0.5) * ((b - a) / 6) AS ts FROM top, (SELECT unnest(range(0, 6)) AS k) q)),
s AS (SELECT id, win, r, min(ts) AS a, max(ts) AS b, round(avg(score), 9) AS score FROM l WHERE win % 3 <> 0 GROUP BY ALL),
z AS (SELECT * FROM s QUALIFY id % 2 = 0 OR row_number() OVER (PARTITION BY id ORDER BY r) = 1)
SELECT id::VARCHAR AS id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, a, b) - 1)::INT AS rank, round(a, 4) AS start_s, round(b, 4) AS end_s, round(score, 6) AS score FROM z""")
def method_coarse_to_fine_64(spark, d):
    return _answers(M.coarse_to_fine(_samples(spark, d), M.Tally(mute=3)))


@query()
def method_multi_evidence(spark, d):
    """With two units of evidence a frame: with one, the scout's rows alone would fill the target."""
    return _answers(M.multi_evidence(_samples(spark, d), M.Tally(units=2)))
