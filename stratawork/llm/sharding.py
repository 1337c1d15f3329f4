"""Shards of near equal bytes by a k-d tree over document metadata; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawork.llm.text import stored

#: Cells of a histogram with which a median is narrowed down.
CELLS = 1024
#: A cut may miss its share by this part of the node's bytes.
TOLERANCE = 0.002
#: Bits of a coordinate, and of the text checksum that orders texts with the same coordinate.
COORDINATE_BITS, TIE_BITS = 20, 32
#: Rows of a shard that one task numbers, roughly.
SLOT_ROWS = 50_000


def text_dimensions() -> dict[str, Column]:
    """Metadata that copies of a text share, each between 0 and 1: size on a log scale, two checksums."""
    return {
        "size": F.log2(F.col("size").cast("double")) / 48,
        "crc32": F.col("text_crc32") / float(2**32),
        "checksum": F.expr("shiftrightunsigned(xxhash64(body, 17), 32)") / float(2**32),
    }


def kd_shards(
    docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None
) -> DataFrame:
    """Put every document into a shard: doc_id, size, text_crc32, shard, slot.

    A node that stands for several shards is cut at the weighted median along its widest dimension (at the matching
    share if the number is odd), until each leaf is one shard; `target_bytes` sets the number of shards where `shards`
    is None. Dimensions are columns between 0 and 1 over size, text_crc32 and body; rows with the same coordinate are
    ordered by a checksum of the text, so equal texts stay together. If a group of equal texts weighs so much that no
    dimension has a cut within the tolerance, the group itself is cut by a checksum of doc_id.

    Medians come from histograms over all rows: a sum for each of 1024 cells, then the same within the cell that holds
    the median, until it weighs less than the tolerance. Only these sums are shuffled, so a hot value is one row for each
    task. A null text has size 1 and the checksum of the empty text. Null and repeated ids are rows like others. slot
    numbers the rows of a shard from 0. Extra columns are ignored.
    """
    body = F.coalesce("text", F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long"), body.alias("body")).select(
        "doc_id", "body", (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32(F.col("body").cast("binary")).alias("text_crc32"),
    )
    dimensions = dimensions or text_dimensions()
    grid = 2**COORDINATE_BITS
    tie = F.expr(f"shiftrightunsigned(xxhash64(body), {64 - TIE_BITS})")
    places = [
        F.least(F.floor(axis * grid), F.lit(grid - 1)).cast("long") * F.lit(2**TIE_BITS) + tie for axis in dimensions.values()
    ]
    rows = stored(
        sized.select(
            "doc_id", "size", "text_crc32", F.array(*places).alias("places"),
            F.expr("shiftrightunsigned(xxhash64(doc_id, text_crc32), 12)").alias("copy"), F.lit(0).alias("first"),
        ),
        "kd-rows",
    )
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    rows = rows.withColumn("shards", F.lit(shards))
    widest = shards
    while widest > 1:
        cuts = _cuts(rows, len(dimensions)).drop("shards")
        at = F.expr("places[axis]")
        right = F.col("left_shards").isNotNull() & (
            (at > F.col("cut")) | ((at == F.col("cut")) & (F.col("copy") > F.col("copy_cut")))
        )
        rows = rows.join(cuts, "first", "left").select(
            "doc_id", "size", "text_crc32", "places", "copy",
            F.when(right, F.col("first") + F.col("left_shards")).otherwise(F.col("first")).alias("first"),
            F.when(F.col("left_shards").isNull(), F.col("shards"))
            .when(right, F.col("shards") - F.col("left_shards"))
            .otherwise(F.col("left_shards")).alias("shards"),
        )
        rows = stored(rows, "kd-rows")
        widest = (widest + 1) // 2
    return _numbered(rows.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"), "copy"))


def _cuts(rows: DataFrame, axes: int) -> DataFrame:
    """For each node of several shards: first, shards, left_shards, axis, cut, copy_cut."""
    nodes = rows.filter("shards > 1")
    spans = [F.struct(F.min(F.expr(f"places[{i}]")).alias("low"), F.max(F.expr(f"places[{i}]")).alias("high")) for i in range(axes)]
    spread = nodes.groupBy("first", "shards").agg(F.sum("size").alias("bytes"), F.array(*spans).alias("spans"))
    left = F.floor(F.col("shards") / 2).cast("int")
    spread = spread.withColumn("left_shards", left).withColumn("share", F.col("bytes") * left / F.col("shards"))
    open_cells = stored(
        spread.select("first", "shards", "left_shards", "bytes", "share", F.posexplode("spans").alias("axis", "span")).select(
            "first", "shards", "left_shards", "bytes", "share", "axis", F.col("span.low").alias("low"),
            F.col("span.high").alias("high"), (F.col("span.high") - F.col("span.low")).alias("width"),
            F.lit(0).cast("long").alias("before"), F.col("bytes").alias("inside"),
        ),
        "kd-cells",
    )
    wide = F.expr(f"greatest(1, ceil((high - low + 1) / {CELLS}))").cast("long")
    while True:
        unsure = F.expr(f"high > low and least(share - before, before + inside - share) > {TOLERANCE} * bytes")
        if not open_cells.filter(unsure).limit(1).count():
            break
        seeking = open_cells.filter(unsure).withColumn("step", wide)
        flat = nodes.select("first", "size", F.posexplode("places").alias("axis", "place"))
        flat = flat.join(seeking.select("first", "axis", "low", "high", "step"), ["first", "axis"])
        cells = flat.filter("place between low and high").groupBy(
            "first", "axis", F.expr("(place - low) div step").alias("cell")
        ).agg(F.sum("size").alias("weight"))
        running = F.sum("weight").over(Window.partitionBy("first", "axis").orderBy("cell"))
        sums = cells.withColumn("running", running).join(seeking, ["first", "axis"])
        chosen = sums.filter(F.expr("before + running >= share")).groupBy("first", "axis").agg(
            F.min(F.struct("cell", "running", "weight")).alias("at")
        )
        narrowed = seeking.join(chosen, ["first", "axis"]).select(
            "first", "shards", "left_shards", "bytes", "share", "axis",
            F.expr("low + at.cell * step").alias("low"),
            F.expr("least(high, low + (at.cell + 1) * step - 1)").alias("high"), "width",
            F.expr("before + at.running - at.weight").alias("before"), F.expr("at.weight").alias("inside"),
        )
        open_cells = stored(open_cells.filter(~unsure).unionByName(narrowed), "kd-cells")
    miss = F.expr("least(share - before, before + inside - share) / bytes")
    fits = miss <= TOLERANCE
    best = open_cells.groupBy("first").agg(
        F.max(
            F.struct(fits.alias("fits"), "width", -F.col("axis"), "shards", "left_shards", "axis", "low", "high", "share", "before", "inside")
        ).alias("best")
    ).select("first", "best.*")
    whole = F.when(F.expr("share - before <= before + inside - share"), F.col("low") - 1).otherwise(F.col("high"))
    best = stored(best.withColumn("cut", F.when(F.col("fits"), whole).otherwise(F.col("low"))), "kd-best")
    return _group_cuts(nodes, best)


def _group_cuts(nodes: DataFrame, best: DataFrame) -> DataFrame:
    """Where a group of equal texts has to be cut, the checksum of doc_id up to which it goes left; else all of it."""
    bits = 52
    heavy = best.filter("not fits").select("first", "axis", "cut", "share", "before")
    group = nodes.join(heavy, "first").filter(F.expr("places[axis] = cut"))
    step = 2 ** (bits - 10)
    cells = group.groupBy("first", "share", "before", F.expr(f"copy div {step}L").alias("cell")).agg(F.sum("size").alias("weight"))
    running = F.sum("weight").over(Window.partitionBy("first").orderBy("cell"))
    lefts = cells.withColumn("running", running).filter(F.expr("before + running - weight / 2 <= share")).groupBy("first").agg(
        ((F.max("cell") + 1) * step - 1).alias("group_cut")
    )
    cuts = best.join(lefts, "first", "left")
    everything = F.when(F.col("fits"), F.lit(2**bits)).otherwise(F.coalesce("group_cut", F.lit(-1)))
    return stored(cuts.select("first", "shards", "left_shards", "axis", "cut", everything.alias("copy_cut")), "kd-cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0: counts of hash buckets, their prefix sums, row numbers within a bucket."""
    buckets = max(256, rows.count() // SLOT_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("copy", "doc_id"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    bases = stored(counts.select("shard", "bucket", ahead.alias("ahead")), "kd-slots")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    placed = dealt.withColumn("within", within).join(bases, ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("ahead") + F.col("within")).cast("long").alias("slot")
    )
