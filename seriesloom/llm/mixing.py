"""Mixing sources to target weights: hash-random order, prefix sums, a cut at each source's budget.

Keys are hashes of the document id, its text and the epoch, so reruns agree and rows without an id part. Within a source the key range is
cut into bins of about ``BIN`` rows and these into groups of ``GROUP`` bins; sums by bin, combined before
the shuffle, give prefix sums over groups, then over the bins of the group that holds a source's cut, and
only the bin of the cut is sorted by row. One task sees a row for each ``BIN * GROUP`` rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch

BIN = 512
#: Bins of a group, as bits.
GROUP_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_mark(text: Column) -> Column:
    """64 bits of the text's hash, in hexadecimal."""
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16)


def epoch_key(doc_id: Column, mark: Column, epoch: Column) -> Column:
    """60 hash-random bits of the id, the text's mark and the epoch."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), mark, epoch.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, n, source_size)``: columns ``weight, target`` are added.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words.
    A target stops at ``most`` times its source's words; the excess goes to the others by weight until
    none is above. In order of cap over weight the stopped sources come first, so that running sums
    find the final level in one pass. One row for each source is sorted in one task.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), at.cast("int") + 1)
    out = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = Window.partitionBy()
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, upto = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    out = (
        out.withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(upto))
    )
    stopped = F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight")
    out = out.withColumn("stopped", stopped)
    cap_sum = F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(total), F.lit(0.0))
    weight_sum = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(total)
    shared = F.col("weight") * (F.col("budget") - cap_sum) / weight_sum
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(shared)
    return out.withColumn("target", target).select("source", "n", "source_size", "weight", "target")


def _cuts(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...]) -> DataFrame:
    """Per source: targets, whole epochs, bins, the bin of the cut, and words left for it."""
    sizes = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights).withColumn("budget", F.floor("target"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("bins", F.ceil(F.col("n") / BIN))
    plan = scratch.table(plan.drop("n", "budget"), "plan")
    sums = _binned(sized, plan).groupBy("source", "bin", "rest").agg(F.sum("size").alias("s"))
    sums = scratch.table(sums.withColumn("group", F.shiftright("bin", GROUP_BITS)), "bins")
    w = Window.partitionBy("source").orderBy("group")
    groups = sums.groupBy("source", "group", "rest").agg(F.sum("s").alias("s")).withColumn("before", F.sum("s").over(w) - F.col("s"))
    holds = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s"))
    group = groups.where(holds).select(F.col("source").alias("g_source"), F.col("group").alias("g"), F.col("before").alias("g_before"))
    inner = sums.join(group, sums["source"].eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g")))
    w = Window.partitionBy("source").orderBy("bin")
    inner = inner.withColumn("before", F.col("g_before") + F.sum("s").over(w) - F.col("s"))
    cut = inner.where(holds).select(F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"), (F.col("rest") - F.col("before")).alias("left"))
    out = plan.join(cut, plan["source"].eqNullSafe(cut["cut_source"]), "left").drop("cut_source")
    return scratch.table(out, "cuts")


def _binned(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with its source's plan, key and bin; the plan has a row a source, so Spark may broadcast it by its measured size."""
    p = plan.withColumnRenamed("source", "plan_source")
    out = sized.join(p, sized["source"].eqNullSafe(p["plan_source"])).drop("plan_source")
    out = out.withColumn("key", epoch_key(F.col("doc_id"), F.col("mark"), F.col("epochs")))
    return out.withColumn("bin", F.shiftright(F.shiftright("key", 30) * F.col("bins"), 30))


def _taken(sized: DataFrame, cuts: DataFrame, ties: list[str]) -> DataFrame:
    """Words taken of each row; rows of the cut bin are cut by their running sum."""
    rows = _binned(sized, cuts)
    full = F.col("epochs") * F.col("size")
    cut_bin = F.coalesce("cut_bin", F.col("bins"))
    outside = rows.where(F.col("bin") != cut_bin).withColumn("taken", full + F.when(F.col("bin") < cut_bin, F.col("size")).otherwise(0))
    w = Window.partitionBy("source").orderBy("key", "doc_id", *ties)
    inside = rows.where(F.col("bin") == cut_bin)
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    inside = inside.withColumn("taken", full + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - before)))
    return outside.unionByName(inside)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Words that the mix takes of each row: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words, 0 for a null or empty text. Null is a source of its own, the last. A source
    without words has target 0. Taken words add up to each source's target rounded down: the document
    at the cut gives the words that are left. A null id is an id; rows alike in id and text share a
    key and stand side by side. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), text_mark(F.col("text").cast("string")).alias("mark"))
    sized = scratch.table(sized, "sized")
    taken = _taken(sized, _cuts(sized, scratch, weights), ["size"])
    return taken.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mix itself: each row of ``docs`` once for each epoch that takes it, none if none does.

    Documents stay whole: the one at the cut is taken if at least half of its words are within. A
    document without words is taken as often as its source's whole epochs, at least once. Null ids and
    sources are values like others; rows alike in id and text share a key and stand side by side, in any
    order. An empty table stays empty. No name of a further column clashes with anything here.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    columns = docs.columns
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), text_mark(F.col("text").cast("string")).alias("mark"), F.struct(*[docs[c] for c in columns]).alias("row"))
    cuts = _cuts(scratch.table(inner.select("doc_id", "source", "size", "mark"), "sized"), scratch, weights)
    taken = _taken(inner, cuts, ["size"])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.greatest(F.col("epochs"), F.lit(1)))
    out = taken.withColumn("times", times.cast("int")).where("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("row.*")
