"""Expressions over evidence: relative positions, endpoint features, dense proposals, prompts, tubelets, pruned grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import intervals as I


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def relative(times: Column, start: Column, end: Column) -> Column:
    """Positions of absolute times in [start, end], cut to 0 .. 1."""
    return F.transform(times, lambda t: unit((t - start) / (end - start)))


def endpoint_features(relative_times: Column) -> Column:
    """For each row of evidence, the two ends of its share of the timeline: half a share to either side, cut to 0 .. 1."""
    half = F.lit(0.5) / F.greatest(F.size(relative_times), F.lit(1))
    return F.transform(relative_times, lambda r: F.struct(unit(r - half).alias("start"), unit(r + half).alias("end")))


def dense_proposals(relative_times: Column, offsets: Column, scores: Column, start: Column, end: Column) -> Column:
    """Spans in absolute time of per-row offsets (struct<start,end>) from the row's position; empty ones are left out."""
    length = end - start
    at = lambda r, x: start + unit(r + x) * length
    rows = F.filter(F.arrays_zip(relative_times.alias("r"), offsets.alias("o"), scores.alias("s")), lambda z: z["o"]["end"] > z["o"]["start"])
    return F.transform(rows, lambda z: I.span(at(z["r"], z["o"]["start"]), at(z["r"], z["o"]["end"]), z["s"]))


def post_nms(spans: Column, cardinality: Column, threshold: float = 0.7, most: int = 100, least_score: float = 0.5, single: int = 10) -> Column:
    """What is left of dense proposals: for `multi` all of a score, or the best one; else the first few."""
    ranked = I.nms(spans, threshold, most)
    good = F.filter(ranked, lambda s: s["score"] >= least_score)
    multi = F.when(F.size(good) > 0, good).otherwise(F.slice(ranked, 1, 1))
    return F.when(cardinality == "multi", multi).otherwise(F.slice(ranked, 1, single))


# The wording of the questions that a predictor is asked; {query} and {seconds} are filled in.
ASK_MULTI = (
    "The event '{query}' may occur MULTIPLE times in this video. List EVERY occurrence as its own [start, end] pair, in chronological order. "
    "Use seconds relative to this evidence window, from 0 to {seconds}. Return ONLY a JSON array of [start, end] pairs, e.g. [[1.0, 3.0], [7.5, 9.0]]. "
    "Do NOT return the whole video as a single pair like [0, {seconds}]. Return [] if the event never occurs."
)
ASK_SINGLE = (
    "Find the best interval where this event occurs: {query}. Use seconds relative to this evidence window, from 0 to {seconds}. "
    "Return only a JSON array of [start, end] pairs. Return [] if absent."
)
# End of fixed values.


def quoted(text: Column) -> Column:
    """The text in quotes: single ones, or double ones if it holds single ones alone; what stands in the way is escaped."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        plain = F.replace(plain, F.lit(c), F.lit(name))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def prompt(query: Column, cardinality: Column, seconds: Column) -> Column:
    def filled(form: str, asked: Column) -> Column:
        parts = F.lit(form)
        for name, value in (("{seconds}", F.format_string("%.3f", seconds.cast("double"))), ("{query}", asked)):
            parts = F.replace(parts, F.lit(name), value)
        return parts

    return F.when(cardinality == "multi", filled(ASK_MULTI, query)).otherwise(filled(ASK_SINGLE, quoted(query)))


RUN = "struct<at:double,n:int,role:string>"


def evidence_runs(times: Column, roles: Column, start: Column) -> Column:
    """Rows of evidence of the same time (to 0.00001), one after the other, as struct<at,n,role>: the last row's time from
    the window's start on, how many rows, and the first row's role. roles may be null."""
    role = F.coalesce(roles, F.transform(times, lambda _: F.lit("")))
    rows = F.transform(F.arrays_zip(times.alias("t"), role.alias("r")), lambda z: F.struct(F.greatest(F.lit(0.0), z["t"] - start).alias("at"), F.lit(1).alias("n"), z["r"].alias("role")))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        more = F.struct(x["at"].alias("at"), (last["n"] + 1).alias("n"), last["role"].alias("role"))
        same = (F.size(done) > 0) & (F.abs(F.try_element_at(done, F.lit(-1))["at"] - x["at"]) < 1e-5)
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(rows, F.array().cast(f"array<{RUN}>"), step)


def evidence_prompt(runs: Column, begin: str = "<v>", unit_token: str = "<u>", end: str = "</v>") -> Column:
    """The runs as text: time, role if there is one, and a token for each row between two marks."""
    one = lambda r: F.concat(F.format_string("<%.2f seconds>", r["at"]), F.when(r["role"] != "", F.concat(F.lit(", "), r["role"])).otherwise(""), F.lit(begin), F.repeat(F.lit(unit_token), r["n"]), F.lit(end))
    return F.array_join(F.transform(runs, one), "")


def tubelet_times(times: Column, tubelets: Column, per_time: Column) -> Column:
    """One time for each unit of evidence of an encoder that groups frames: the mean of the times that fall to a tubelet,
    `per_time` times over. Cuts between tubelets are at the rounded share of the frames."""
    n = F.size(times)
    cut = lambda i: F.bround(i * n / tubelets).cast("int")
    width = lambda i: F.greatest(F.lit(1), cut(i + 1) - cut(i))

    def centre(i: Column) -> Column:
        own = F.slice(times, F.least(cut(i), n - 1) + 1, width(i))
        return F.aggregate(own, F.lit(0.0), lambda a, t: a + t) / F.size(own)

    return F.flatten(F.transform(F.sequence(F.lit(0), tubelets.cast("int") - 1), lambda i: F.array_repeat(centre(i), per_time.cast("int"))))


def pruned_grid(t: Column, h: Column, w: Column, merge: int, ratio: float) -> tuple[Column, Column]:
    """Tokens that stay (numbers from 0, frame after frame) and the grid that is left, if of merge x merge cells every
    other row (ratio 0.5) or every other row and column (0.25) is kept."""
    if ratio not in (0.5, 0.25):
        raise ValueError("the ratio must be 0.5 or 0.25")
    across = 2 if ratio == 0.25 else 1
    rows, columns = F.floor(h / merge).cast("int"), F.floor(w / merge).cast("int")
    upto = lambda n, by=1: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(by))).otherwise(F.array().cast("array<int>"))
    cell = lambda f, r, c: F.transform(F.sequence(F.lit(0), F.lit(merge * merge - 1)), lambda i: (f * h * w + (r * columns + c) * merge * merge + i).cast("long"))
    row = lambda f, r: F.flatten(F.transform(upto(columns, across), lambda c: cell(f, r, c)))
    frame = lambda f: F.flatten(F.transform(upto(rows, 2), lambda r: row(f, r)))
    tokens = F.flatten(F.transform(upto(t.cast("int")), frame))
    grid = F.array(t.cast("int"), F.ceil(rows / 2).cast("int") * merge, F.ceil(columns / across).cast("int") * merge)
    return tokens, grid


def taken(values: Column, indices: Column) -> Column:
    """values at the given numbers (from 0), in the order asked for; a number beyond them raises."""
    return F.transform(indices, lambda i: F.element_at(values, i.cast("int") + 1))
