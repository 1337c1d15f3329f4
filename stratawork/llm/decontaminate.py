"""Documents that contain passages of a benchmark, found by spaced-seed hashing.

A mask picks eight words of a window and ignores the others, so a passage with a few replaced words still shares hashes
with the benchmark. The hashes are joined, and every hit is verified along its alignment on the full word sequences.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import BY_SIGN, constants, long_lists, mixed, steps, stored, words

#: Fixed masks: words under 1 are hashed, those under 0 may differ. Wherever two words of SHARE_WORDS are replaced, one of
#: the masks fits beside them.
MASKS = (
    "11111111", "1101101111", "111010011011", "1011001010111", "1110111011", "11011100111", "1111010111",
)
#: A hit is an overlap if its best stretch reaches this score: one for an equal word, minus two for a replaced one ...
LEAST_SCORE = 10
#: ... or if this share (per cent) of so many words in a row is equal, or of the whole item if it is shorter than that.
LEAST_SHARE, SHARE_WORDS = 80, 13
#: Shorter items must be there word for word.
LEAST_WORDS = 8
#: The filter of benchmark hashes has 64 bits for each of them, up to 32 MB; beyond that more rows reach the exact join.
MOST_FILTER_BITS = 2**28
#: Benchmark hashes and document ids are broadcast up to this number of rows (24 bytes each); else they are shuffled.
BROADCAST_ROWS = 500_000


def _short_masks(n: int) -> list[tuple[str, int, int]]:
    """Masks for items of n words, fewer than SHARE_WORDS: mask, the item's word that it begins at, seed of its constants.

    The words are cut into parts, of which each mask leaves out as many as words may be replaced, so one mask always fits.
    """
    spare = (100 - LEAST_SHARE) * n // 100 if n >= LEAST_WORDS else 0
    part = np.arange(n) * 4 // n
    out = []
    for number, gone in enumerate(itertools.combinations(range(4), spare) if spare else [()]):
        mask = "".join("0" if p in gone else "1" for p in part)
        out.append((mask.strip("0"), mask.index("1"), 1000 + 10 * n + number))
    return out


def _hashes(found, masks):
    """For each mask, given with the seed of its constants, the window hashes and the index of their first word."""
    h, doc = found.hash, found.doc
    for mask, seed in masks:
        factors = constants(len(mask), seed)
        span = len(mask)
        at = np.flatnonzero(doc[: 1 - span or None] == doc[span - 1 :]) if len(doc) >= span else np.empty(0, np.int64)
        sums = np.zeros(len(at), np.uint64)
        for k, used in enumerate(mask):
            if used == "1":
                sums += factors[k] * h[at + k]
        yield mixed(sums), at


def _bounds(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(rows + 1))


def _seeded(masks):
    return [(mask, 41 + number) for number, mask in enumerate(masks)]


def _items(masks):
    def seeds_of(found, first):
        """Window hashes and their first words: of all items by `masks`, of short ones by the masks of their length too."""
        yield from _hashes(found, _seeded(masks))
        size = np.diff(first)
        for n in np.unique(size[(size > 0) & (size < SHARE_WORDS)]).tolist():
            starts = first[:-1][size == n]
            for mask, begin, seed in _short_masks(n):
                for value, at in _hashes(found, [(mask, seed)]):
                    own = np.isin(at, starts + begin)
                    yield value[own], at[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = words(batch.column("text"), BY_SIGN, by_script=True)
            first = _bounds(found.doc, batch.num_rows)
            value, at = (np.concatenate(x) for x in zip(*seeds_of(found, first)))
            order = np.argsort(found.doc[at], kind="stable")
            value, at = value[order], at[order]
            owner = found.doc[at]
            seeds = _bounds(owner, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_key"), long_lists(found.hash, first), long_lists(value, seeds),
                    long_lists(at - first[owner], seeds),
                ],
                ["item_key", "item_words", "seeds", "places"],
            )

    return run


def _candidates(masks, lengths, bits):
    """`lengths` are the numbers of words of the items shorter than SHARE_WORDS."""
    several = [*_seeded(masks), *((mask, seed) for n in lengths if n >= LEAST_WORDS for mask, _, seed in _short_masks(n))]
    whole = [(mask, seed) for n in lengths if n < LEAST_WORDS for mask, _, seed in _short_masks(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        mask = np.uint64(len(table) * 64 - 1)

        def listed(value: np.ndarray) -> np.ndarray:
            """Indexes of the hashes that the filter holds: four bits of each must be set."""
            left = np.arange(len(value))
            for part in range(4):
                bit = (value[left] >> np.uint64(9 * part)) & mask
                left = left[(table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            return left

        for batch in steps(batches):
            found = words(batch.column("text"), BY_SIGN, by_script=True)
            values, places = [], []
            for value, at in _hashes(found, several):
                hit = listed(value)
                values.append(value[hit])
                places.append(at[hit])
            for value, at in _hashes(found, whole):
                hit = listed(value)
                value, at = value[hit], at[hit]
                # A short item that is there word for word is there as a whole: its first place in a document will do.
                order = np.lexsort((at, value, found.doc[at]))
                value, at = value[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (found.doc[at[1:]] != found.doc[at[:-1]])
                values.append(value[new])
                places.append(at[new])
            value, at = np.concatenate(values), np.concatenate(places)
            order = np.argsort(found.doc[at], kind="stable")
            value, at = value[order], at[order]
            rows, new = np.unique(found.doc[at], return_index=True)
            if not len(rows):
                continue
            first = _bounds(found.doc, batch.num_rows)
            kept = pa.array(rows)
            sizes = np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])])
            own = np.concatenate([found.hash[first[r] : first[r + 1]] for r in rows])
            bounds = np.append(new, len(value))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(kept), batch.column("doc_key").take(kept),
                    long_lists(own, sizes), long_lists(value, bounds), long_lists(at - first[found.doc[at]], bounds),
                ],
                ["doc_id", "doc_key", "doc_words", "seeds", "places"],
            )

    return run


def _filter_bits(seeds: DataFrame, number: int) -> np.ndarray:
    """The benchmark hashes as a bit table, put together by Spark; at most MOST_FILTER_BITS / 64 numbers are fetched."""
    size = 2**10
    while size < 64 * number and size < MOST_FILTER_BITS:
        size *= 2
    bit = F.explode(F.array(*[F.expr(f"shiftrightunsigned(seed, {9 * k}) & {size - 1}L") for k in range(4)]))
    slots = seeds.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")
    )
    table = np.zeros(size // 64, np.uint64)
    fetched = slots.toArrow()
    table[fetched.column("slot").to_numpy()] = fetched.column("bits").to_numpy().view(np.uint64)
    return table


def _doc_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs.doc_id.cast("long"), docs.text)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST_SCORE) -> DataFrame:
    """Documents with a passage of the benchmark: doc_id, item_id, score, matched, item_words, word_at, doc_key.

    Words are runs of letters, digits and non-ASCII signs in lower case; non-ASCII punctuation and spaces separate them,
    and each sign of a script without spaces (Chinese, Japanese, Thai, ...) is a word. One row for each document and
    benchmark item of which a verified stretch scores `least` or more (an equal word counts one, a replaced one minus
    two), or has LEAST_SHARE per cent equal words among SHARE_WORDS in a row, or among all words of a shorter item. Items
    under LEAST_WORDS words must be there word for word. Stretches on different alignments are not added up. score is
    that of the best stretch; word_at is the document's word that the item's first word is aligned with, matched the
    number of equal words on that alignment. Any two replaced words of SHARE_WORDS leave a seed to find them by. Null or
    wordless texts never match. Items with the same text are all reported; repeated documents give one row for each id
    and text. Null ids are carried through. Extra columns are ignored.
    """
    spark = docs.sparkSession
    session = spark.sparkContext
    items = stored(benchmark.select("item_id", F.lower("text").alias("text"), F.xxhash64("text").alias("item_key")), "items")
    sequences = stored(
        items.filter("text is not null").dropDuplicates(["item_key"]).select("item_key", "text").mapInArrow(
            _items(masks), "item_key long, item_words array<long>, seeds array<long>, places array<long>"
        ),
        "sequences",
    )
    seeds = sequences.select("item_key", F.explode(F.arrays_zip("seeds", "places")).alias("at")).select(
        F.col("at.seeds").alias("seed"), F.col("at.places").alias("item_at"), "item_key"
    )
    number = seeds.count()
    bits = session.broadcast(_filter_bits(seeds, number))
    short = sequences.select(F.size("item_words").alias("n")).filter(f"n between 1 and {SHARE_WORDS - 1}").distinct()
    lengths = sorted(r.n for r in short.collect())
    lowered = docs.select(docs.doc_id.cast("long"), _doc_key(docs).alias("doc_key"), F.lower("text").alias("text"))
    found = stored(
        lowered.mapInArrow(
            _candidates(masks, lengths, bits),
            "doc_id long, doc_key long, doc_words array<long>, seeds array<long>, places array<long>",
        ),
        "candidates",
    )
    hits = found.select("doc_key", F.explode(F.arrays_zip("seeds", "places")).alias("at")).select(
        "doc_key", F.col("at.seeds").alias("seed"), F.col("at.places").alias("doc_at")
    )
    small = F.broadcast if number <= BROADCAST_ROWS else (lambda df: df)
    aligned = hits.join(small(seeds), "seed").select("doc_key", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    aligned = aligned.groupBy("doc_key", "item_key", "shift").agg(F.count("*").alias("hits"))
    whole = found.select("doc_id", "doc_key", "doc_words").dropDuplicates(["doc_key"])
    both = aligned.join(whole, "doc_key").join(small(sequences.select("item_key", "item_words")), "item_key")
    both = both.withColumns({
        "doc_from": F.greatest(F.col("shift"), F.lit(0)).cast("int"),
        "item_from": F.greatest(-F.col("shift"), F.lit(0)).cast("int"),
    }).withColumn("long", F.expr("least(size(doc_words) - doc_from, size(item_words) - item_from)"))
    both = both.withColumn(
        "same",
        F.expr("zip_with(slice(doc_words, doc_from + 1, long), slice(item_words, item_from + 1, long), (x, y) -> x = y)"),
    )
    score = F.expr(
        "aggregate(same, struct(0 as now, 0 as best),"
        " (s, x) -> struct(greatest(s.now + if(x, 1, -2), 0) as now, greatest(s.best, s.now + if(x, 1, -2)) as best),"
        " s -> s.best)"
    )
    share = (
        f"size(item_words) >= {LEAST_WORDS} and exists(sequence(1, greatest(size(same) - {SHARE_WORDS - 1}, 1)), i ->"
        f" 100 * size(filter(slice(same, i, {SHARE_WORDS}), x -> x)) >= {LEAST_SHARE} * least(size(item_words), {SHARE_WORDS}))"
    )
    verified = both.withColumn("score", score).filter(F.expr(f"score >= least({least}, size(item_words)) or {share}")).select(
        "doc_id", "doc_key", "item_key", "score", F.expr("size(filter(same, x -> x))").alias("matched"),
        F.size("item_words").alias("item_words"), F.col("shift").alias("word_at"),
    )
    best = verified.groupBy("doc_id", "doc_key", "item_key").agg(
        F.max(F.struct("score", "matched", -F.col("word_at"), "item_words")).alias("best")
    )
    named = best.join(items.select("item_id", "item_key"), "item_key")
    return named.select(
        "doc_id", "item_id", "best.score", "best.matched", "best.item_words", (-F.col("best.col3")).alias("word_at"), "doc_key"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark, with all their columns."""
    gone = stored(overlaps(docs, benchmark).select("doc_key").distinct(), "contaminated")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, _doc_key(docs) == gone.doc_key, "left_anti")
