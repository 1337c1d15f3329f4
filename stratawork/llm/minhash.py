"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two values of the signature, its smallest and its largest, so a signature
of 128 values costs 64 evaluations for each shingle. Bands of four values (both ends of two permutations) give the
candidates; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawork.llm.graph import components
from stratawork.llm.text import BY_SPACE, constants, long_lists, mixed, shingles, steps, stored, words

#: Hash permutations; each gives a minimum and a maximum.
PERMUTATIONS = 64
#: Permutations in a band. Two make four values: a pair of large sets at similarity 0.75 is missed by all 32 bands once in
#: 190 000. The minimum and maximum of a small set depend on each other, so there it would be far more often.
PER_BAND = 2
#: Sets of fewer shingles are joined by prefixes, which misses nothing, whether they share a bucket or not.
SMALL_SET = 16
#: Candidate ids are broadcast up to this number (24 MB); beyond it the texts are joined with them.
BROADCAST_IDS = 1_000_000
#: Shingles that are known to be frequent where the rest is compared; the others count as rare. This only orders them.
FREQUENT, LEAST_COUNT = 200_000, 8
#: Ratio of set sizes within a size class.
SIZE_RATIO = 1.1

_SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"


def _signatures(width: int, permutations: int, per_band: int):
    flips, factors = constants(permutations, 23), constants(permutations, 29)
    join = constants(2 * per_band, 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = batch.num_rows
            values, bounds = shingles(words(batch.column("text"), BY_SPACE), rows, width)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            bands = np.zeros((rows, permutations // per_band), np.uint64)
            set_a, set_b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            if len(full):
                first = bounds[full]
                set_a[full] = np.add.reduceat(values, first)
                set_b[full] = np.add.reduceat(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), first)
                for p in range(permutations):
                    seen = (values ^ flips[p]) * factors[p]
                    at, band = 2 * (p % per_band), p // per_band
                    bands[full, band] += join[at] * mixed(np.minimum.reduceat(seen, first))
                    bands[full, band] += join[at + 1] * mixed(np.maximum.reduceat(seen, first))
            per_row = np.arange(rows + 1) * bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(size.astype(np.int64)),
                    pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)),
                    long_lists(mixed(bands.ravel()), per_row),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values, bounds = shingles(words(batch.column("text"), BY_SPACE), batch.num_rows, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), long_lists(values, bounds)],
                ["rep", "shingles"],
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", common)
        .filter(100 * F.col("common") >= threshold * (F.size("of_a") + F.size("of_b") - F.col("common")))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: int = 75, permutations: int = PERMUTATIONS, per_band: int = PER_BAND
) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, text_hash, n_shingles, component_id, kept.

    Words are what stands between ASCII white space, with A-Z lower-cased; a document's set holds its distinct shingles
    of `width` words, or all its words as one shingle if it has fewer. Documents are linked if the intersection of their
    sets is at least `threshold` per cent of the union; component_id is the smallest doc_id that links reach.

    Documents with equal sets become one vertex first, so thousands of copies cost one row. The members of a bucket are
    held against its most central member, the one that meets most others in all bands. Where a bucket is still in
    several parts, those outside its largest part are joined with the members of all such buckets by prefixes of their
    sets: no link between different parts is lost, and no bucket is expanded into its pairs. Sets of fewer than SMALL_SET
    shingles are joined by prefixes at once.

    Null or wordless texts have no shingle, are linked with nothing and kept. Rows without doc_id are kept, with a null
    component. Links are between sets, so rows that repeat a doc_id are one document as far as their texts are alike:
    texts unlike each other are in classes of their own, also if these have the same component_id. Of each class the
    rows with its smallest (doc_id, text_hash) are kept. Extra columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stored(source.mapInArrow(_signatures(width, permutations, per_band), _SIGNATURE), "signatures")
    reps = stored(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands")).alias("first"))
        .select(
            F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "first.doc_id", "first.text_hash", "first.bands",
            "first.n_shingles",
        ),
        "representatives",
    )
    banded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(banded.join(stored(shared, "buckets"), ["band", "bucket"]).select("band", "bucket", "rep", "members"), "met")
    central = met.groupBy("rep").agg(F.sum("members").alias("meetings"))
    ranked = met.join(stored(central, "central"), "rep")
    pivots = ranked.groupBy("band", "bucket").agg(F.max(F.struct("meetings", -F.col("rep"), "rep")).alias("top"))
    pivots = stored(pivots.select("band", "bucket", F.col("top.rep").alias("pivot")), "pivots")
    members = stored(met.select("band", "bucket", "rep").join(pivots, ["band", "bucket"]), "members")
    linked = _linked(source, reps, members, width, threshold)
    named = stored(linked.join(reps.select("rep", "doc_id", "text_hash"), F.col("id") == F.col("rep")), "linked")
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    heads = named.select("rep", "component").join(heads, "component").select("rep", "head")
    classes = reps.join(heads, "rep", "left").select(
        "set_a", "set_b", F.coalesce("head.doc_id", "doc_id").alias("class"), F.coalesce("head.text_hash", "text_hash").alias("first")
    )
    classes = stored(classes, "classes")
    member = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    is_first = (F.col("doc_id") == F.col("class")) & (F.col("text_hash") == F.col("first"))
    return signed.drop("bands").join(classes, ["set_a", "set_b"], "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(member, F.col("class")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(member, is_first).otherwise(True).alias("kept"),
    )


def _linked(source: DataFrame, reps: DataFrame, members: DataFrame, width: int, threshold: int) -> DataFrame:
    """Components (id, component) of the representatives that have a confirmed link."""
    small = reps.filter(F.col("n_shingles") * threshold <= 100 * (SMALL_SET - 1)).select("rep", "n_shingles")  # with partners
    used = members.select("rep").union(small.select("rep")).distinct()
    wanted = stored(used.join(reps.select("rep", "doc_id", "text_hash"), "rep"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = source.join(wanted, ["doc_id", "text_hash"]).select("rep", "text")
    sets = stored(texts.mapInArrow(_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep"]), "sets")

    def tested(pairs: DataFrame) -> DataFrame:
        """Confirmed links among candidate pairs (rep, other), each compared once."""
        distinct = pairs.filter("rep != other").select(
            F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")
        )
        return stored(_confirmed(distinct.distinct(), sets, threshold), "links")

    links = tested(members.select("rep", F.col("pivot").alias("other")))
    labels = components(links)
    parts = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "band", "bucket", "rep", F.coalesce("component", "rep").alias("part")
    )
    sized = parts.groupBy("band", "bucket", "part").agg(F.count("*").alias("n"))
    split = sized.groupBy("band", "bucket").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
    split = stored(split.filter("parts > 1").select("band", "bucket", "main"), "split")
    apart = parts.join(split, ["band", "bucket"]).groupBy("rep", "part").agg(F.max(F.expr("part != main")).alias("outside"))
    short = small.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("part"), (F.col("n_shingles") < SMALL_SET).alias("outside")
    )
    apart = apart.select("rep", "part", "outside").union(short).groupBy("rep", "part").agg(F.max("outside").alias("outside"))
    apart = stored(apart.join(sets, "rep"), "apart")
    found = tested(_prefix_pairs(apart, threshold))
    return components(links.unionByName(found)) if found.limit(1).count() else labels


def _prefix_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """All pairs (rep, other) of different parts, the first one `outside`, that may be similar enough.

    Two sets with an overlap of o share a shingle among the first (size - o + 1) of each in any common order. Frequent
    shingles come last, so members of a large group that is connected already do not meet on what they all hold. The
    overlap that is needed depends on both sizes, so prefixes are given for each size class of the other set.
    """
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    frequent = counts.filter(f"count >= {LEAST_COUNT}").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    order = np.argsort(frequent.column("shingle").to_numpy())
    shared = sets.sparkSession.sparkContext.broadcast(
        (frequent.column("shingle").to_numpy()[order], frequent.column("count").to_numpy()[order])
    )
    lows = np.unique(np.ceil(SIZE_RATIO ** np.arange(250)).astype(np.int64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            values, bounds = batch.column("shingles").flatten().to_numpy(), batch.column("shingles").value_lengths().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(bounds)])
            weight = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                weight = np.where(known[at] == values, count[at], 0)
            row, token, own, other = [], [], [], []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = b - a
                ranked = values[a:b][np.lexsort((values[a:b], weight[a:b]))]
                mine, least = int(np.searchsorted(lows, n, "right")) - 1, -(-threshold * n // 100)
                last = int(np.searchsorted(lows, 100 * n // threshold, "right"))
                for c in range(int(np.searchsorted(lows, least, "right")) - 1, last):
                    needed = -(-threshold * (n + max(int(lows[c]), least)) // (100 + threshold))
                    if needed <= n:
                        token.append(ranked[: n - needed + 1])
                        row.append(np.full(len(token[-1]), k))
                        own.append(np.full(len(token[-1]), mine, np.int32))
                        other.append(np.full(len(token[-1]), c, np.int32))
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("rep", "part", "outside")),
                     *(pa.array(np.concatenate(x)) for x in (token, own, other))],
                    ["rep", "part", "outside", "shingle", "own", "other_class"],
                )

    schema = "rep long, part long, outside boolean, shingle long, own int, other_class int"
    rows = stored(sets.mapInArrow(prefixes, schema), "prefixes")
    left = rows.filter("outside").select("rep", "part", "shingle", "own", "other_class")
    right = rows.select(
        F.col("rep").alias("other"), F.col("part").alias("other_part"), "shingle", F.col("own").alias("other_class"),
        F.col("other_class").alias("own"),
    )
    return left.join(right, ["shingle", "own", "other_class"]).filter("part != other_part").select("rep", "other").distinct()


def deduplicated(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """The documents that are kept: one of each class, with all their columns."""
    gone = stored(
        near_duplicates(docs, width, threshold).filter("not kept").select("doc_id", "text_hash").distinct(), "dropped"
    )
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    id_and_hash = (docs.doc_id.cast("long") == gone.doc_id) & (F.xxhash64(docs.text) == gone.text_hash)
    return docs.join(gone, id_and_hash, "left_anti")
