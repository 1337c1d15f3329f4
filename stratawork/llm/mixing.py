"""A mix of sources at target weights, by Efraimidis-Spirakis sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawork.llm.text import stored, word_count

#: Words of the mix come from the sources in these shares, by the order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: A source gives no more than so many times its words.
MOST_REPEATS = 3
#: Keys of a source are summed in so many ranges; only the range in which its budget ends is ordered by rows.
RANGES = 4096


def letter_share() -> Column:
    """Quality weight of a text between 0.5 and 1: half of its share of letters (A-Z, a-z, non-ASCII) plus a half."""
    letters = F.length(F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.coalesce(0.5 + 0.5 * letters / F.greatest(F.length("text"), F.lit(1)), F.lit(0.5))


def _keyed(docs: DataFrame, quality: Column) -> DataFrame:
    """Each document packed as `row`, with its size, weight and exponential key ln(u) / weight, u drawn from a digest of the id.

    What is packed first can't clash with the names added here, whatever a document's columns are called.
    """
    row = F.struct(*[docs[name] for name in docs.columns]).alias("row")
    named = docs.select(row, "doc_id", "source", word_count().alias("mix_size"), quality.alias("mix_weight"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(2**52)
    return named.withColumn("mix_key", F.log(uniform) / F.col("mix_weight"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """For each source (source, source_size) its weight and target.

    Targets share the sum of all sizes by weight and stop at `most` times the source's size; what is above is shared
    again. With the sources ordered by how soon they are full, the full ones come first, so prefix sums over one row for
    each source give the level of the others directly.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * most
    named = sizes.withColumn("weight", weight).withColumn("full_at", full / F.col("weight"))
    soonest = everything.orderBy("full_at", F.col("source").asc_nulls_last())
    given = F.coalesce(F.sum(full).over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - given) / open_weight
    leveled = named.withColumn("level", level)
    first = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True)
    shared = first.over(soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.least(full.cast("double"), shared * F.col("weight"))).drop("level", "full_at")


def _plan(slim: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source: its target, its complete epochs, and the key and id with which its last epoch ends."""
    sizes = slim.groupBy("source").agg(
        F.sum("mix_size").alias("source_size"), F.round(F.avg("mix_weight"), 3).alias("mean_weight")
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = source_targets(sizes, weights, most).withColumn("epochs", epochs.cast("long"))
    targets = stored(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    key_range = F.floor((1 - F.exp(F.col("mix_key") * F.col("mean_weight"))) * RANGES).cast("int")
    same = slim.source.eqNullSafe(targets.source)
    ranged = slim.join(targets, same).drop(targets.source).withColumn("key_range", key_range)
    per_range = ranged.groupBy("source", "rest", "key_range").agg(F.sum("mix_size").alias("words"))
    by_key = Window.partitionBy("source").orderBy("key_range")
    before = F.sum("words").over(by_key) - F.col("words")
    ends = (
        per_range.withColumn("before", before)
        .filter(F.col("before") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("key_range", "before")).alias("end"))
        .select("source", F.col("end.key_range").alias("end_range"), F.col("end.before").alias("end_before"))
    )
    ends = stored(ends, "mix-ends")
    last = ranged.join(ends, ranged.source.eqNullSafe(ends.source) & (F.col("key_range") == F.col("end_range"))).drop(ends.source)
    within = Window.partitionBy("source").orderBy(F.col("mix_key").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    started = F.col("end_before") + F.coalesce(F.sum("mix_size").over(within), F.lit(0))
    chosen = last.withColumn("started", started).filter(F.col("started") + F.col("mix_size") / 2 <= F.col("rest"))
    cuts = chosen.groupBy("source").agg(F.max(F.struct(-F.col("mix_key"), F.col("doc_id"))).alias("cut"))
    cuts = cuts.select("source", (-F.col("cut.col1")).alias("cut_key"), F.col("cut.doc_id").alias("cut_id"))
    ends_and_cuts = ends.join(cuts, ends.source.eqNullSafe(cuts.source), "left").drop(cuts.source)
    whole = targets.join(ends_and_cuts, targets.source.eqNullSafe(ends_and_cuts.source), "left").drop(ends_and_cuts.source)
    return stored(whole.withColumnRenamed("source", "mix_source"), "mix-plan")


def _mixture(docs: DataFrame, weights: tuple[int, ...], most: int, quality: Column | None) -> DataFrame:
    """row (all columns of a document), mix_size, source_size, target, mix_copies."""
    quality = letter_share() if quality is None else quality
    keyed = _keyed(docs, quality)
    slim = stored(keyed.drop("row"), "mix-slim")
    plan = _plan(slim, weights, most)
    key_range = F.floor((1 - F.exp(F.col("mix_key") * F.col("mean_weight"))) * RANGES).cast("int")
    at_cut = (F.col("mix_key") == F.col("cut_key")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id")))
    before_cut = (key_range == F.col("end_range")) & ((F.col("mix_key") > F.col("cut_key")) | at_cut)
    again = (F.col("rest") > 0) & F.coalesce((key_range < F.col("end_range")) | before_cut, F.lit(False))
    joined = keyed.join(plan, keyed.source.eqNullSafe(plan.mix_source))
    copies = (F.col("epochs") + F.when(again, 1).otherwise(0)).cast("long")
    return joined.select("row", "mix_size", "source_size", "target", copies.alias("mix_copies"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, quality: Column | None = None
) -> DataFrame:
    """The documents with size, source_size, target, copies and taken added.

    Size is the number of words. Sources in the order of their names, null last, get the weights in turn. A source gives
    as many complete epochs as fit its target; the rest comes from documents in the order of exponential keys scaled by
    the quality weight (a column above 0, the letter share if not given), up to the document that comes closest to the
    target. Keys depend on doc_id alone, so reruns agree. Documents without words take no budget; they are copied like
    others. Rows that repeat a doc_id share a key: once the last of them fits, all are taken. Null texts have size 0.
    Sources without words have target 0. An empty table stays empty. Other columns are kept; those named like an added
    one are replaced.

    Only sums by source and key range are shuffled, never texts: the budget of each source ends in one of 4096 ranges of
    its keys, and only the rows of that range are sorted, so a source with a third of all rows is no single task.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [F.col("row")[name].alias(name) for name in docs.columns if name not in added]
    taken = F.col("mix_copies") * F.col("mix_size")
    return _mixture(docs, weights, most, quality).select(
        *own, F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_copies").alias("copies"), taken.alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    chosen = _mixture(docs, weights, most, None).filter("mix_copies > 0")
    repeated = chosen.select("row", F.explode(F.expr("sequence(1, cast(mix_copies as int))")))
    return repeated.select("row.*")
