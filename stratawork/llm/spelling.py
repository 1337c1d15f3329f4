"""Spelling variants of a corpus's words, found by asymmetric q-chunks.

A word gives its two halves as disjoint chunks. Its possible partners give the grams of the same lengths at the places
that a chunk can be within one of. One edit spoils at most one of the two chunks, so a join of chunks and grams finds
every pair that is one edit apart; the pairs are verified on the whole words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import stored

#: Words are at least so long and so frequent.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 5
#: One in so many pairs of document and run loses a sign.
DAMAGE = 199

_RUN = "[A-Za-zÀ-ÿ]+"
#: Code points of a text that are searched at a time, and words whose counts a task holds before it passes them on.
_PIECE, _HELD = 1_000_000, 200_000


def _counter(least_length: int, damage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lower = re.compile(_RUN), {c: c + 32 for c in range(65, 91)}
        counts: defaultdict[str, int] = defaultdict(int)

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text, at, runs = text.as_py(), 0, Counter()
                while at < len(text):
                    to = min(at + _PIECE, len(text))
                    if rest := found.match(text, to):  # no run is cut
                        to = rest.end()
                    runs.update(found.findall(text, at, to))
                    at = to
                doc_id = doc.as_py()
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    if len(word) < least_length:
                        continue
                    word = word.lower() if word.isascii() else word.translate(lower)
                    h = zlib.crc32(word.encode(), before)
                    if h % damage == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield passed_on()
        if counts:
            yield passed_on()

    return run


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE
) -> DataFrame:
    """Words of all texts and how often they occur: word, n.

    Runs are letters A to Z and U+00C0 to U+00FF; only A-Z are lower-cased. Where `damage` divides the crc32 of
    `<doc_id>:<run>`, the run's sign at crc32 % length is deleted, in all places of that document alike. A null id counts
    as empty text, a null text has no runs, repeated rows count again, other columns are ignored. A task counts its texts
    before it passes words on, so a frequent word is one row for each task.
    """
    own = docs.select("doc_id", "text").filter("text is not null")
    parts = own.mapInArrow(_counter(least_length, damage), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _gram(word: str, start: Column, length: Column, of_length: Column, which: Column) -> Column:
    """Key of a gram: equal keys are equal grams that stand for the same chunk of a word of that length."""
    return F.xxhash64(of_length, which, F.substring(F.col(word), start + 1, length))


def _chunks(words: DataFrame) -> DataFrame:
    """Both halves of each word (without the sign in the middle of an odd one): key, word."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    keys = [_gram("word", at, half, size, F.lit(which)) for which, at in ((0, F.lit(0)), (1, size - half))]
    return words.select("word", F.explode(F.array(*keys)).alias("key"))


def _grams(words: DataFrame, least_length: int) -> DataFrame:
    """Grams of each word that are within one place of a chunk of a word one longer, one shorter or as long: key, near."""
    size, keys = F.length("near"), []
    for longer in (-1, 0, 1):
        partner = size + longer
        half = F.floor(partner / 2).cast("int")
        for which, chunk in ((0, F.lit(0)), (1, partner - half)):
            for shift in (-1, 0, 1):
                at = chunk + shift
                there = (partner >= least_length) & (at >= 0) & (at + half <= size)
                keys.append(F.when(there, _gram("near", at, half, partner, F.lit(which))))
    named = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return named.select("near", "near_n", F.explode(F.array_distinct(F.array(*keys))).alias("key")).filter("key is not null")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """All pairs of words one inserted, deleted or replaced sign apart, both ways: word, near, near_n (the partner's n).

    `words` has columns word and n, each word once and of `least_length` signs at least.
    """
    met = _chunks(words).join(_grams(words, least_length), "key")
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """Where the forms of each word end: word, root. The way that is covered doubles in each round.

    Forms grow by FORM_RATIO, so ways are short and have no circles.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(
            ways.join(beyond, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            ),
            "forms",
        )
        ways = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return ways


def spelling_groups(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = FORM_RATIO) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n.

    `words` (word, n) holds each word once. Near words are one edit apart. A word's form is its most frequent near word
    (of equally frequent ones the smallest in code-point order), if that is `ratio` times as frequent, else null; root is
    where the forms end, the word itself if it has none. Without words there are no rows.
    """
    words = stored(words.select("word", "n"), "words")
    best = near_words(words, least_length).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best")
    )
    known = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
            F.when(-F.col("best.n") >= ratio * F.col("n"), -F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
