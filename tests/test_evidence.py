import math

import pytest
from pyspark.sql import functions as F

from spanloom.functions import evidence as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def values(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_dense_proposals_and_selection(spark):
    times = [12.0, 20.0, 28.0, 44.0]
    rel = V.relative(values(times), F.lit(10.0), F.lit(30.0))
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((-0.3, 0.1), (-0.1, 0.1), (0.2, -0.2), (-0.5, 0.0))])
    r = one(spark, rel=rel, ends=V.endpoint_features(rel), spans=V.dense_proposals(rel, offsets, values([0.4, 0.9, 1.0, 0.3]), F.lit(10.0), F.lit(30.0)))
    assert r.rel == [0.1, 0.5, 0.9, 1.0] and [(round(e.start, 9), round(e.end, 9)) for e in r.ends] == [(0.0, 0.225), (0.375, 0.625), (0.775, 1.0), (0.875, 1.0)]
    assert [(round(s.start, 6), round(s.end, 6), s.score) for s in r.spans] == [(10.0, 14.0, 0.4), (18.0, 22.0, 0.9), (20.0, 30.0, 0.3)]
    spans = F.lit(None).cast("int")
    spans = V.dense_proposals(rel, offsets, values([0.4, 0.9, 1.0, 0.3]), F.lit(10.0), F.lit(30.0))
    pick = lambda kind, least=0.5: [s.score for s in one(spark, p=V.post_nms(spans, F.lit(kind), least_score=least)).p]
    assert pick("multi") == [0.9] and pick("multi", 2.0) == [0.9] and pick("single") == [0.9, 0.4, 0.3]


def test_prompts(spark):
    r = one(spark, m=V.prompt(F.lit("door opens"), F.lit("multi"), F.lit(12.5)), s=V.prompt(F.lit("the cook's hand"), F.lit("single"), F.lit(3)))
    assert "'door opens' may occur MULTIPLE" in r.m and r.m.count("12.500") == 2
    assert f'occurs: {"the cook" + chr(39) + "s hand"!r}.' in r.s and "from 0 to 3.000." in r.s
    for text in ("plain", "it's", 'say "so"', 'it\'s "so"', "a\\b", "line\nbreak\ttab"):
        assert one(spark, q=V.quoted(F.lit(text))).q == repr(text)


def test_evidence_runs(spark):
    runs = V.evidence_runs(values([5.0, 5.000001, 7.0, 5.0]), F.array(*map(F.lit, ["a", "b", "", "c"])), F.lit(4.0))
    r = one(spark, runs=runs, text=V.evidence_prompt(runs))
    assert [(x.n, x.role) for x in r.runs] == [(2, "a"), (1, ""), (1, "c")] and abs(r.runs[0].at - 1.000001) < 1e-9
    assert r.text == "<1.00 seconds>, a<v><u><u></v><3.00 seconds><v><u></v><1.00 seconds>, c<v><u></v>"
    none = V.evidence_runs(values([1.0]), F.lit(None).cast("array<string>"), F.lit(4.0))
    assert [(x.at, x.role) for x in one(spark, r=none).r] == [(0.0, "")]


@pytest.mark.parametrize("ratio, rows, columns", [(0.5, 2, 1), (0.25, 2, 2)])
def test_pruned_grid(spark, ratio, rows, columns):
    for t, h, w in ((2, 6, 4), (1, 4, 6), (3, 2, 2)):
        tokens, grid = V.pruned_grid(F.lit(t), F.lit(h), F.lit(w), 2, ratio)
        r = one(spark, k=tokens, g=grid)
        want = [f * h * w + (y * (w // 2) + x) * 4 + i for f in range(t) for y in range(0, h // 2, rows) for x in range(0, w // 2, columns) for i in range(4)]
        assert r.k == want and r.g == [t, math.ceil(h / 2 / rows) * 2, math.ceil(w / 2 / columns) * 2] and len(want) == math.prod(r.g)
    with pytest.raises(ValueError):
        V.pruned_grid(F.lit(1), F.lit(2), F.lit(2), 2, 0.7)


def test_tubelets_and_taken(spark):
    r = one(spark, c=V.tubelet_times(values([0, 1, 2, 3, 4]), F.lit(2), F.lit(3)), t=V.taken(values([5, 6, 7]), F.array(F.lit(2), F.lit(0))))
    assert r.c == [0.5] * 3 + [3.0] * 3 and r.t == [7.0, 5.0]
