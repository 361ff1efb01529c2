"""Interval expressions: spans are struct<start,end,score> arrays, all Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:double,end:double,score:double>"
# Fixed value: two numbers with a comma, a hyphen or `to` between.
PAIR = r"(-?\d+(?:\.\d+)?)\s*(?:,|-|to)\s*(-?\d+(?:\.\d+)?)"


def span(start: Column, end: Column, score: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), score.cast("double").alias("score"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans; 0 where the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def clip(spans: Column, duration: Column) -> Column:
    """Spans cut to [0, duration]; what is empty then is left out."""
    cut = F.transform(spans, lambda s: span(F.greatest(F.lit(0.0), s["start"]), F.least(duration, s["end"]), s["score"]))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def shift(spans: Column, offset: Column) -> Column:
    return F.transform(spans, lambda s: span(s["start"] + offset, s["end"] + offset, s["score"]))


def parse_spans(text: Column) -> Column:
    """Spans in a model's answer: a JSON list of pairs (or one under `spans` or `timestamps`), else pairs in the text.

    The score is 1 / (index + 1) by the index before empty spans are left out.
    """
    rows = F.from_json(text, "array<array<double>>")
    named = F.from_json(text, "spans array<array<double>>, timestamps array<array<double>>")
    listed = F.when(F.ltrim(text).startswith("{"), F.coalesce(named["spans"], named["timestamps"])).otherwise(rows)
    pairs = F.filter(F.coalesce(listed, F.array().cast("array<array<double>>")), lambda p: p.isNotNull() & (F.size(p) >= 2) & F.element_at(p, 2).isNotNull())
    found = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("b")),
        lambda z: F.array(z["a"].cast("double"), z["b"].cast("double")),
    )
    every = F.when(F.size(pairs) > 0, pairs).otherwise(F.coalesce(found, F.array().cast("array<array<double>>")))
    spans = F.transform(every, lambda p, i: span(F.element_at(p, 1), F.element_at(p, 2), F.lit(1.0) / (i + 1)))
    return F.filter(spans, lambda s: s["end"] > s["start"])


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def by_score(spans: Column) -> Column:
    """Highest score first, then start, then end."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: span(s["start"], s["end"], -s["k"]))


def nms(spans: Column, threshold: float = 0.7, maximum: int | None = None) -> Column:
    """Greedy suppression: a span goes if its IoU with one already kept is above the threshold."""

    def step(kept: Column, s: Column) -> Column:
        drop = F.exists(kept, lambda k: iou(k, s) > threshold)
        if maximum is not None:
            drop = drop | (F.size(kept) >= maximum)
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(by_score(spans), _empty(), step)


def merge(spans: Column, gap: float = 0.0) -> Column:
    """Spans in time order, those that start within `gap` of the end before joined; a joined span has the best score."""
    ordered = F.array_sort(F.transform(spans, lambda s: span(s["start"], s["end"], s["score"])))

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = span(last["start"], F.greatest(last["end"], s["end"]), F.greatest(last["score"], s["score"]))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"] + gap), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, _empty(), step)


def consolidate(spans: Column, duration: Column, duplicate: float = 0.8, gap: float = 3.0) -> Column:
    return by_score(merge(nms(clip(spans, duration), duplicate), gap))


def length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]))


def overlap(a: Column, b: Column) -> Column:
    """Length of the intersection of two lists of disjoint spans."""
    one = lambda x: F.aggregate(F.transform(b, lambda y: F.greatest(F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(a, one), F.lit(0.0), lambda s, v: s + v)


def set_iou(a: Column, b: Column) -> Column:
    """IoU of the merged unions of two span lists."""
    x, y = merge(a), merge(b)
    both = overlap(x, y)
    union = length(x) + length(y) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def best_iou(s: Column, others: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda t: iou(s, t))), F.lit(0.0))
