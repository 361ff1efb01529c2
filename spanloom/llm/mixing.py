"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: a source's weight is its turn in 3, 1, 2 by code point (null last); all targets together are `share` of all
words, none is above `most` times its source, and the excess goes to the others by weight (water filling).

Blocks: a source's documents are dealt by hash into blocks of about equal size. Its quota in blocks is exact: whole
passes over all of them and, of the last pass, so many permuted blocks as its target asks for; the block where the
target ends is cut at the document, and that document at the word, by the same hashes at finer digits: so no step
gathers more than a small part of a source.

Tree: the block quotas of all sources are split over 2**levels output shards. At each node, of n blocks with c_s of
source s, the left child gets a multivariate-hypergeometric count of each source: the blocks, not yet told apart, draw
numbers and the lower half goes left. A shard then draws its quota of each source: disjoint stretches of the source's
permuted blocks, shard after shard. What a shard has drawn is shuffled there by itself.

Everything is SQL expressions over hashes of ids: reruns agree whatever the partitioning.

Defined results: null and empty texts have size 0 and are never taken; a source without words has target 0; rows that
share doc_id and text are drawn alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, n_words

WEIGHTS = (3, 1, 2)  # fixed by the contract
WORD_STARTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
BLOCK, FINER = 8, 12  # bits of a hash that name a block, and the finer part within one


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, source_size, target of each source. sizes: key, source, source_size; as many rows as sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), turn + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    level = F.col("cap") / F.col("weight")
    by_level = Window.orderBy("level", "key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = weighed.withColumn("level", level)
    full = full.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all_w": F.sum("weight").over(every),
        "total": F.sum("source_size").over(every) * F.lit(share),
    })
    # the water level if exactly the sources before this one are full; the first that stays below its own cap decides
    full = full.withColumn("water", (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("used")))
    full = full.withColumn("held", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(every))
    return full.select("key", "source_size", F.when(F.col("held").isNull() | (F.col("level") < F.col("held.level")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("held.water"))).alias("target"))


def _named(docs: DataFrame, seed: int) -> tuple:
    """key (the source's name) and h (what all draws of a row hang on) of docs' rows."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return key.alias("key"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")).alias("h")


def quotas(blocks: DataFrame, seed: int, levels: int) -> DataFrame:
    """key, ends (array of struct(end, shard)): which of a source's blocks, by number, each shard gets. blocks: key, n."""
    balls = blocks.select("key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ball")).withColumn("node", F.lit(0))
    for level in range(levels):
        w = Window.partitionBy("node")
        drawn = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed + 2 + level), "node", "key", "ball"), "key", "ball"))
        right = (drawn > F.floor(F.count("*").over(w) / 2)).cast("int")
        balls = balls.withColumn("node", 2 * F.col("node") + right)
    share = balls.groupBy("key", "node").count()
    upto = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    share = share.withColumn("end", F.sum("count").over(upto))
    return share.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", F.col("node").alias("shard")))).alias("ends"))


def plan(docs: DataFrame, seed: int = 7, share: float = 1.5, most: float = 2.0, levels: int = 3) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, passes (array of struct(pass, words, shard,
    place)), key, h."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *_named(docs, seed), n_words(F.col("text")).alias("size"))
    base = materialize(base, "mix-rows")
    digits = {
        "d0": F.shiftrightunsigned("h", 64 - BLOCK).cast("int"),
        "d1": F.shiftrightunsigned("h", 64 - BLOCK - FINER).bitwiseAND((1 << FINER) - 1).cast("int"),
    }
    rows = base.withColumns(digits)
    # sums by the first digit, for sources and their blocks in one pass
    blocks = materialize(rows.groupBy("key", "d0").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-blocks")
    sizes = blocks.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goal = targets(sizes, share, most).withColumn("quota", F.floor("target"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = materialize(goal.withColumn("part", F.col("quota") - F.col("whole") * F.col("source_size")), "mix-goal")

    # the permuted blocks of the last, partial pass: whole ones, and the one where the quota ends
    upto = Window.partitionBy("key").orderBy("turn", "d0").rowsBetween(Window.unboundedPreceding, -1)
    dealt = blocks.withColumn("turn", F.xxhash64(F.lit(seed + 1), "key", "d0"))
    dealt = dealt.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(goal, "key")
    dealt = dealt.select("key", "d0", "words", "whole", (F.col("part") - F.col("before")).alias("room"))
    dealt = dealt.withColumn("state", F.when(F.col("room") >= F.col("words"), "all").when(F.col("room") <= 0, "none").otherwise("cut"))
    cut = dealt.where("state = 'cut'").select("key", "d0", "room")  # one block of each source at most
    # the same within it, by the second digit, then by documents
    finer = rows.join(cut, ["key", "d0"]).groupBy("key", "d0", "d1").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    upto1 = Window.partitionBy("key").orderBy("d1").rowsBetween(Window.unboundedPreceding, -1)
    finer = finer.withColumn("room", F.col("room") - F.coalesce(F.sum("words").over(upto1), F.lit(0)))
    last = rows.join(finer.where("room > 0").select("key", "d0", "d1", "room", "words"), ["key", "d0", "d1"])
    full_bins = last.where("room >= words").select("key", "h", F.col("size").alias("cut_words"))
    upto2 = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    some = last.where("room < words").withColumn("room", F.col("room") - F.coalesce(F.sum("size").over(upto2), F.lit(0))).where("room > 0")
    some = some.select("key", "h", F.least("size", "room").alias("cut_words"))
    # repeated rows share evenly what was drawn of them
    partial = full_bins.unionByName(some).groupBy("key", "h").agg(F.sum("cut_words").alias("cut_words"))

    # each source's blocks of all passes, in permuted order, meet the quotas of the tree's leaves
    slots = dealt.select("key", "d0", "state", F.explode(F.sequence(F.lit(1), F.col("whole") + 1)).alias("pass"), "whole")
    slots = slots.where("pass <= whole or state != 'none'")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("pass", F.xxhash64(F.lit(seed + 1), "key", "d0", "pass"), "d0"))
    slots = slots.withColumn("number", turn)
    split = quotas(slots.groupBy("key").agg(F.count("*").cast("int").alias("n")), seed, levels)
    shard = F.filter("ends", lambda e: e["end"] >= F.col("number"))[0]["shard"]
    draw = F.struct("pass", shard.alias("shard"), (F.col("pass") > F.col("whole")).alias("last"))
    drawn = slots.join(split, "key").groupBy("key", "d0").agg(F.array_sort(F.collect_list(draw)).alias("draws"), F.first("state").alias("state"))
    drawn = materialize(drawn, "mix-drawn")

    copies = Window.partitionBy("key", "h")
    partial = rows.join(partial, ["key", "h"]).select("key", "h", "cut_words", F.count("*").over(copies).alias("copies")).distinct()
    out = rows.join(goal.select("key", "source_size", "target"), "key").join(drawn, ["key", "d0"], "left").join(partial, ["key", "h"], "left")
    in_part = F.floor(F.coalesce(F.col("cut_words") / F.col("copies"), F.lit(0)))
    words = lambda d: F.when(~d["last"] | (F.col("state") == "all"), F.col("size")).otherwise(in_part)
    taken = lambda d: F.struct(d["pass"].alias("pass"), words(d).cast("long").alias("words"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 99), "h", d["pass"]).alias("place"))
    draws = F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int,last:boolean>>"))
    out = out.withColumn("passes", F.filter(F.transform(draws, taken), lambda p: p["words"] > 0))
    total = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", total.alias("taken"), "passes", "key", "h")


def query(docs: DataFrame) -> DataFrame:
    of = lambda name: F.transform("passes", lambda x: x[name]).alias(name + "s")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", of("shard"), of("place"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs' rows as the mix holds them: a row for each pass that takes some of its words, cut where the quota ends.

    All columns of docs, whatever their names. Partitions follow each other by shard and, within it, by place; a shard
    is as many partitions as its size asks for.
    """
    drawn = plan(docs, seed).where("size(passes) > 0").select("key", "h", "passes").dropDuplicates(["key", "h"])
    rows = docs.select(F.struct("*").alias("row"), *_named(docs, seed)).join(drawn, ["key", "h"])
    rows = rows.select("row", F.explode("passes").alias("p"), n_words(F.col("row.text")).alias("n"))
    pieces = F.split("row.text", WORD_STARTS, -1)  # each with the white space behind it; white space in front is one of its own
    ahead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("p.words").cast("int") + ahead), "")
    less = F.col("p.words") < F.col("n")
    rows = rows.withColumn("row", F.col("row").withField("text", F.when(less, cut).otherwise(F.col("row.text"))))
    if "n_chars" in docs.columns:
        own = F.when(less, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        rows = rows.withColumn("row", F.col("row").withField("n_chars", own))
    rows = rows.select("row", "p.shard", "p.place")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("row.*")
