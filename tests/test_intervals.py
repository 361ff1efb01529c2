import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import intervals as I
from spanloom.functions import timeline as T
from spanloom.operators import evaluation as E
from spanloom.operators import selection as S
from spanloom.plans import catalog
from spanloom.plans import methods as M

ARR = f"spans array<{I.SPAN}>"


def one(spark, spans, column, **extra):
    df = spark.createDataFrame([([tuple(map(float, s)) for s in spans],)], ARR)
    return df.select(column.alias("r")).first()["r"]


def test_nms_is_strict_and_ordered(spark):
    got = one(spark, [(0, 10, 0.9), (0, 10, 0.5), (20, 30, 0.7)], I.nms(F.col("spans"), 0.7))
    assert [tuple(x) for x in got] == [(0, 10, 0.9), (20, 30, 0.7)]
    assert len(one(spark, [(0, 10, 0.9), (0, 5, 0.5)], I.nms(F.col("spans"), 0.5))) == 2
    assert one(spark, [], I.nms(F.col("spans"))) == []


def test_nms_and_merge_equal_loops(spark):
    rnd = random.Random(1)
    rows = [(i, [(a := float(rnd.randint(0, 40)), a + rnd.randint(1, 12), rnd.randint(1, 9) / 10) for _ in range(rnd.randint(0, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, f"id int, {ARR}").select("id", I.nms(F.col("spans"), 0.3).alias("n"), I.merge(F.col("spans"), 3.0).alias("m"))
    own = dict(rows)
    for r in df.collect():
        kept = []
        for s in sorted(own[r.id], key=lambda s: (-s[2], s[0], s[1])):
            if all(max(0, min(s[1], k[1]) - max(s[0], k[0])) / (s[1] - s[0] + k[1] - k[0] - max(0, min(s[1], k[1]) - max(s[0], k[0]))) <= 0.3 for k in kept):
                kept.append(s)
        assert [tuple(x) for x in r.n] == kept
        merged = []
        for a, b, c in sorted(own[r.id]):
            if merged and a <= merged[-1][1] + 3:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), max(merged[-1][2], c))
            else:
                merged.append((a, b, c))
        assert [tuple(x) for x in r.m] == merged


@pytest.mark.parametrize("text, want", [("[[1, 2], [5, 4], [6, 8]]", [(1, 2, 1.0), (6, 8, 1 / 3)]), ("from 3 to 9", [(3, 9, 1.0)]), ("[1, 2]", [(1, 2, 1.0)]), ('{"spans": [[0, 4]]}', [(0, 4, 1.0)]), ("none", [])])
def test_parse(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(I.parse_spans(F.col("t")).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == want


def test_assignment_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        g = [[rnd.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(g[i][j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), min(n, m)) for q in itertools.combinations(range(m), min(n, m)))
        pairs = E.assign(g)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert abs(sum(g[i][j] for i, j in pairs) - best) < 1e-9


def by_permutations(spans, targets):
    """IoUs of the best one-to-one matching."""
    iou = lambda a, b: max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / (a[1] - a[0] + b[1] - b[0] - max(0.0, min(a[1], b[1]) - max(a[0], b[0])))
    few, many = sorted((spans, targets), key=len)
    return max(([iou(a, b) for a, b in zip(few, p)] for p in itertools.permutations(many, len(few))), key=sum)


@pytest.mark.parametrize("most", [None, 4])
def test_assignment_of_events_equals_brute_force(spark, tmp_path, most):
    rnd = random.Random(5)
    rows, spans = [], {}
    for user, n, m in ((1, 6, 6), (2, 5, 7), (3, 2, 3), (4, 7, 0)):
        for kind, count in (("click", n), ("purchase", m)):
            for _ in range(count):
                at, value = rnd.randint(0, 60), float(rnd.randint(10, 300))
                rows.append((len(rows), f"2024-01-{1 + at // 24:02d} {at % 24:02d}:00:00", user, kind, value))
                spans.setdefault((user, kind), []).append((float(at), len(rows), at + value / 10))
    d = str(tmp_path)
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    cut = lambda *key: [(a, b) for a, _, b in sorted(spans.get(key, []))[:most]]
    pairs = [(cut(u, "click"), cut(u, "purchase")) for u in (1, 2, 3)]  # the fourth has no targets
    hits = [sum(x >= 0.3 for x in by_permutations(p, t)) for p, t in pairs]
    r = catalog.assignment_metrics(spark, d).first() if most is None else E.multi_summary(catalog._records(spark, d, most)).first()
    assert r["count"] == 3
    assert r.c_acc == pytest.approx(100 * sum(len(p) == len(t) for p, t in pairs) / 3, abs=1e-4)
    assert r.cardinality_error == pytest.approx(sum(abs(len(p) - len(t)) for p, t in pairs) / 3, abs=1e-4)
    assert r.tp_3 == pytest.approx(100 * sum(h / len(p) for h, (p, _) in zip(hits, pairs)) / 3, abs=1e-4)
    assert r.tr_3 == pytest.approx(100 * sum(h / len(t) for h, (_, t) in zip(hits, pairs)) / 3, abs=1e-4)


def test_perfect_prediction(spark):
    rec = spark.createDataFrame([(1, [(0.0, 2.0, 1.0), (5.0, 8.0, 1.0)], [(0.0, 2.0, 1.0), (5.0, 8.0, 1.0)]), (2, [(0.0, 1.0, 1.0)], [])], f"id int, {ARR}, targets array<{I.SPAN}>")
    r = E.multi_summary(rec).first()
    assert (r["count"], r.c_acc, r.etf1, r.t_iou) == (1, 100, 100, 100)
    r = E.single_summary(spark.createDataFrame([(1, [(5.0, 8.0, 1.0)], [(1.0, 2.0, 1.0), (5.0, 8.0, 1.0)])], rec.schema)).first()
    assert (r.miou, r.r1_7) == (1, 1)


@pytest.mark.parametrize("duration, n, last", [(45, 1, (0, 45)), (64, 1, (0, 64)), (65, 2, (41, 65)), (90, 2, (41, 90)), (300, 7, (246, 300)), (3600, 88, (3567, 3600))])
def test_uniform_windows(spark, duration, n, last):
    w = spark.range(1).select(T.uniform_windows(F.lit(float(duration))).alias("w")).first()["w"]
    assert len(w) == n and tuple(w[-1]) == last


@pytest.mark.parametrize("n, want", [(2, (2, 2, 4, 56)), (5, (5, 3, 4, 44)), (13, (13, 4, 4, 12)), (16, (16, 4, 3, 16)), (22, (22, 5, 2, 20)), (30, (30, 6, 1, 34)), (90, (48, 7, 1, 16))])
def test_budget(n, want):
    *got, shares = T.plan_budget(n)
    assert tuple(got) == want and sum(shares) == want[3] and all(s % 2 == 0 and s >= 2 for s in shares)


def test_boundary_windows(spark):
    w = spark.range(1).select(T.windows_from_boundaries(F.lit(70.0), F.array(F.lit(55.0))).alias("w")).first()["w"]
    assert [tuple(x) for x in w] == [(10, 70)]


def test_seeded_subsets_nest(spark):
    s = spark.createDataFrame([(str(i),) for i in range(23)], "id string")
    got = {p: {r.id for r in S.seeded_subset(spark, s, "id", 7, p).collect()} for p in (0, 10, 12.5, 20, 37, 100)}
    assert [len(got[p]) for p in got] == [0, 3, 3, 5, 9, 23] and got[10] <= got[20] <= got[37]


def test_subset_sizes_are_those_of_floats(spark):
    s = spark.range(375).select(F.col("id").cast("string").alias("id"))
    assert S.seeded_subset(spark, s, "id", 1, 17.6).count() == math.ceil(375 * 17.6 / 100) == 67
    twice = s.where("id < 3").unionByName(s.where("id < 3"))
    assert S.seeded_subset(spark, twice, "id", 1, 100).count() == 6
    assert [S.percent_key(p) for p in (0.00001, 5, 12.5, 100, 33.3333333)] == ["p000.00001", "p005", "p012.5", "p100", "p033.333333"]
    for bad in (-1, 101, float("nan")):
        with pytest.raises(ValueError):
            S.percent_key(bad)


def test_one_call_for_each_window_and_cardinality(spark):
    """Of one occurrence, the first window by rank that has a span gives its first; of several, all do."""
    kinds = [(str(i), f"v{i}", 300.0, "x", "single" if i % 2 else "multi") for i in range(6)]
    samples = spark.createDataFrame(kinds, "id string, video string, duration double, query string, cardinality string")
    windows = [(41.0 * i, 300.0 if i == 6 else 41.0 * i + 45) for i in range(7)]
    _, kept, each, _, shares = T.plan_budget(7)
    got = {r.id: [(round(s.start, 6), round(s.end, 6)) for s in r.spans] for r in M.coarse_to_fine(samples, M.Tally(mute=2)).collect()}
    score = lambda i, t: (math.floor(t * 2) * 7919 + i * 104729) % 1009 / 1009
    bins = lambda a, b, n: [a + (k + 0.5) * (b - a) / n for k in range(n)]
    for i in range(6):
        rank = sorted(range(7), key=lambda w: (-max(score(i, t) for t in bins(*windows[w], each)), w))[:kept]
        spans = [(w, bins(*windows[w], shares[k])) for k, w in enumerate(rank) if w % 2]
        spans = [(round(ts[0], 6), round(ts[-1], 6)) for _, ts in spans]
        assert got[str(i)] == spans[:1] if i % 2 else sorted(got[str(i)]) == sorted(spans)


def test_first_band_and_anchors(spark):
    bands = spark.createDataFrame([("a", 1, 0.0, 5.0, "start"), ("a", 2, 4.0, 9.0, "end")], "id string, win int, start double, end double, role string")
    rows = spark.createDataFrame([("a", 4.5), ("a", 9.0), ("a", 9.5), ("b", 1.0)], "id string, ts double")
    assert [r.role for r in S.first_band(rows, bands).orderBy("id", "ts").collect()] == ["start", "end", "boundary", "boundary"]
    merged = spark.createDataFrame([("a", 0, 1.0, 0.1), ("a", 1, 1.0, 0.5), ("a", 2, 1.0 + 5e-6, 0.9), ("a", 3, 2.0, 0.2), ("a", 4, 2.0, 0.2)], "id string, idx long, ts double, score double")
    scout = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 2.0)], "id string, ts double")
    assert [r.idx for r in S.scout_anchors(merged, scout).where("anchor").orderBy("idx").collect()] == [1, 3]
    order = spark.createDataFrame([("a", 0, 3), ("a", 1, 1)], "id string, pos int, idx long")
    assert [r.score for r in S.select_rows(merged, order).orderBy("pos").collect()] == [0.2, 0.5]
    with pytest.raises(Exception, match="no row of evidence"):
        S.select_rows(merged, order.withColumn("idx", F.lit(9).cast("long"))).collect()


def test_status(spark):
    want = spark.createDataFrame([(1,), (2,)], "id int")
    for ids, status in (([], "failed"), ([1], "partial"), ([1, 2], "complete")):
        assert E.run_summary(want, spark.createDataFrame([(i,) for i in ids], "id int"), "id").first().status == status
    assert E.run_summary(want.where("false"), want, "id").first().status == "empty"


@pytest.mark.parametrize("name", M.METHODS.names())
def test_methods(spark, name):
    samples = spark.createDataFrame([("a", "v", 30.0, "x"), ("b", "w", 200.0, "y")], "id string, video string, duration double, query string").withColumn("cardinality", F.lit("multi"))
    got = M.METHODS.create(name)(samples, M.Stub()).collect()
    assert {r.id for r in got} == {"a", "b"} and all(r.spans for r in got)


@pytest.mark.parametrize("every", [None, 45.0])
def test_coarse_to_fine_takes_any_number_of_windows(spark, every):
    assert all(T.plan_budget(n) == T.plan_budget(400) for n in (48, 401, 900, 5000))
    samples = spark.createDataFrame([("a", "v", 200.0, "x"), ("b", "w", 20_000.0, "y")], "id string, video string, duration double, query string").withColumn("cardinality", F.lit("multi"))
    cuts = every and samples.select("id", F.transform(F.sequence(F.lit(1), F.floor(F.col("duration") / every).cast("int") - 1), lambda i: i * every).alias("boundaries"))
    seen = []

    class Watching(M.Stub):
        def predict(self, evidence, samples):
            seen.append({r.id: r["count"] for r in evidence.groupBy("id").count().collect()})
            return super().predict(evidence, samples)

    got = {r.id: r.spans for r in M.coarse_to_fine(samples, Watching(), cuts).collect()}
    assert set(got) == {"a", "b"} and all(got.values())
    assert seen[0]["b"] == T.plan_budget(401)[3]


class Peaked(M.Stub):
    """Scores fall with the distance from a peak; embeddings are alike near it and keep what predict was given."""

    def __init__(self, peak, limit=None):
        super().__init__()
        self.peak, self.limit = peak, limit

    def encode(self, rows):
        turn = F.col("ts") / 4
        return rows.withColumn("emb", F.array(F.cos(turn), F.sin(turn)))

    def score(self, rows, samples):
        return rows.withColumn("score", -F.abs(F.col("ts") - self.peak))

    def predict(self, evidence, samples):
        self.evidence = [r.asDict() for r in evidence.orderBy("id", "idx").collect()]
        return super().predict(evidence, samples)


def packed(rows, target, anchors, near=0.51, alike=0.98):
    """T4 over (ts, score, emb) in the order of their places."""
    kept, goal = list(anchors), min(len(rows), max(target, len(anchors)))
    fresh = lambda i: all(abs(rows[i][0] - rows[j][0]) > near or sum(a * b for a, b in zip(rows[i][2], rows[j][2])) < alike for j in kept)
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1], i))
    n, first, last = min(goal - len(kept), math.ceil(math.sqrt(goal))), rows[0][0], rows[-1][0] + 1e-6
    for b in range(n):
        edges = [first + (last - first) * k / n for k in (b, b + 1)]
        kept += [i for i in order if edges[0] <= rows[i][0] < edges[1] and i not in kept and fresh(i)][:1]
    for check in (fresh, lambda i: True):
        for i in order:
            if len(kept) < goal and i not in kept and check(i):
                kept.append(i)
    return sorted(kept)


def test_multi_evidence_packs_bands_without_near_duplicates(spark, monkeypatch):
    samples = spark.createDataFrame([("a", "v", 40.0, "x"), ("b", "w", 61.0, "y")], "id string, video string, duration double, query string").withColumn("cardinality", F.lit("multi"))
    given, whole = [], S.diverse_pack
    monkeypatch.setattr(S, "diverse_pack", lambda rows, *args, **more: given.extend(rows.collect()) or whole(rows, *args, **more))
    backend = Peaked(23.0)
    M.multi_evidence(samples, backend, fps=(0.1, 1.0, 3.0), ratio=0.25).collect()
    assert given
    for sample, duration in (("a", 40.0), ("b", 61.0)):
        rows = sorted((r for r in given if r.id == sample), key=lambda r: r.idx)
        scout = {}
        for i, r in enumerate(rows):
            if r.role == "global_anchor":
                scout.setdefault(round(r.ts, 6), i)
        goal = round(math.ceil(duration * 3) * 0.25)
        assert len(rows) > goal > len(scout)
        want = packed([(r.ts, r.score, r.emb) for r in rows], goal, scout.values())
        assert [r["idx"] for r in backend.evidence if r["id"] == sample] == [rows[i].idx for i in want]
    backend = Peaked(23.0, limit=12)
    M.multi_evidence(samples, backend, fps=(0.1, 1.0, 3.0), ratio=0.25).collect()
    assert [sum(r["id"] == x for r in backend.evidence) for x in ("a", "b")] == [12, 12]


def test_coverage_query_keeps_ends_and_bands(spark):
    samples = spark.createDataFrame([("a", "v", 40.0, "x"), ("b", "w", 61.0, "y"), ("c", "u", 150.0, "z")], "id string, video string, duration double, query string").withColumn("cardinality", F.lit("multi"))
    for limit in (None, 9):
        backend = Peaked(23.0, limit)
        M.coverage_query(samples, backend).collect()
        for sample, duration in (("a", 40.0), ("b", 61.0), ("c", 150.0)):
            n = int(duration * 2)
            ts = [(i + 0.5) * duration / n for i in range(n)]
            goal = min(round(n / 8), limit or n)
            bands = math.ceil(math.sqrt(goal))
            order = sorted(range(n), key=lambda i: (-(-abs(ts[i] - 23.0)), i))
            chosen = {0, n - 1}
            for k in range(bands):
                low, high = (ts[0] + (ts[-1] + 1e-6 - ts[0]) * j / bands for j in (k, k + 1))
                chosen |= set([i for i in order if low <= ts[i] < high][:1])
            chosen |= set([i for i in order if i not in chosen][: max(0, goal - len(chosen))])
            want = sorted(sorted(chosen, key=order.index)[:goal])
            assert [r["idx"] for r in backend.evidence if r["id"] == sample] == want, (sample, limit)
            assert {0, n - 1} <= set(want)


def test_registry():
    r = M.Registry("thing")
    r.register("a", int)
    with pytest.raises(ValueError):
        r.register("a", int)
    with pytest.raises(KeyError):
        r.create("b")
