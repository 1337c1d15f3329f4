"""Words and shingles of whole Arrow batches as 64-bit hashes, and small helpers the operators share.

The hashes are numpy expressions over the bytes of a whole batch, so no Python object is made per word. They are the
same on every machine and in every run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawork.session import new_folder

#: Bytes of text that one numpy step works on; a longer single text is still taken whole.
STEP_BYTES = 2_000_000


#: Bytes of an Arrow batch between the JVM and a Python worker; both hold it, and twice that while it grows.
BATCH_BYTES = 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside pass rows to Python workers in batches of BATCH_BYTES; a longer single row is still passed whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out() -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4 are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte 0 if it separates words, else its value plus one with A-Z lower-cased."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are what stands between these bytes.
BY_SPACE = byte_classes(b" \t\n\x0b\x0c\r")
#: Words are letters, digits and all that is not ASCII.
BY_SIGN = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words(NamedTuple):
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `step` bytes of text, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[0]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


_MULTIPLIERS = constants(256, 7)


#: Signs of scripts that set no space between words: Thai to Tibetan, Myanmar, Khmer, kana, Han and their extensions.
_UNSPACED = (
    (0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3130), (0x31A0, 0x31C0),
    (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1AFF0, 0x1B170),
    (0x20000, 0x40000),
)


_SIGN_KINDS: np.ndarray | None = None


def _sign_kinds() -> np.ndarray:
    """For each code point below 0x40000: 0 part of a word, 1 a word of its own, 2 a separator.

    Made once in each process. A plain global travels with the functions that read it; a decorated function would be
    looked up by name in workers that need not have the package.
    """
    global _SIGN_KINDS
    if _SIGN_KINDS is not None:
        return _SIGN_KINDS
    kinds = np.zeros(0x40000, np.uint8)
    for a, b in _UNSPACED:
        kinds[a:b] = 1
    kinds[[c for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "PZ"]] = 2
    kinds[[0x200B, 0xFEFF]] = 2
    _SIGN_KINDS = kinds
    return kinds


def _other_signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and kind of the non-ASCII signs of UTF-8 bytes that are not just part of a word."""
    lead = np.flatnonzero(data >= 0xC2)
    first = data[lead]
    more = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = (first & (0x3F >> more)).astype(np.int64)
    for k in (1, 2, 3):
        there = more >= k
        code[there] = code[there] << 6 | data[np.minimum(lead[there] + k, len(data) - 1)] & 0x3F
    kind = np.where(code < 0x40000, _sign_kinds()[np.minimum(code, 0x3FFFF)], 0)
    special = kind > 0
    return lead[special], np.minimum(lead + more + 1, len(data))[special], kind[special]


def words(texts: pa.Array, classes: np.ndarray = BY_SPACE, by_script: bool = False) -> Words:
    """Every word of a text column: its hash, the row it is in, and its bytes within the column.

    With `by_script` non-ASCII punctuation and spaces separate words too, and each sign of a script that sets no space
    between words is a word.
    """
    global _MULTIPLIERS
    offsets, data = text_bytes(texts)
    folded = classes[data]
    cuts = np.empty(0, np.int64)
    if by_script and len(data):
        at, to, kind = _other_signs(data)
        cuts = np.concatenate([at[kind == 1], to[kind == 1]])
        at, to = at[kind == 2], to[kind == 2]
        for k in range(4):
            folded[(at + k)[at + k < to]] = 0
    inside = folded != 0
    n = len(inside)
    if not inside.any():
        none = np.empty(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[cuts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    length = end - start
    if (longest := int(length.max())) > len(_MULTIPLIERS):
        _MULTIPLIERS = constants(longest, 7)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    sums = np.add.reduceat(folded[inside].astype(np.uint64) * _MULTIPLIERS[place], first)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(mixed(sums + length.astype(np.uint64)), doc, start, end)


def shingles(found: Words, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the rows' offsets into them.

    A row with fewer words than `width` has all its words as its one shingle; without words it has none.
    """
    factors = constants(width, 11)
    h, doc = found.hash, found.doc
    count = np.bincount(doc, minlength=rows)
    at = np.flatnonzero(doc[: 1 - width or None] == doc[width - 1 :]) if len(doc) >= width else np.empty(0, np.int64)
    sums = np.zeros(len(at), np.uint64)
    for k in range(width):
        sums += factors[k] * h[at + k]
    value, owner = mixed(sums), doc[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        sums = count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(width - 1):
            there = k < count[short]
            sums[there] += factors[k] * h[first[there] + k]
        value, owner = np.concatenate([value, mixed(sums)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(rows + 1))


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(text: str, most: int, number: int = 5) -> Column:
    """A text of up to `most` characters, or of a longer one so many pieces, evenly spread over all of it, as long in sum."""
    size, part = F.length(text), most // number
    cut = [F.substring(F.col(text), F.floor((size - part) * (k / (number - 1))).cast("int") + 1, F.lit(part)) for k in range(number)]
    return F.when(size > most, F.concat_ws("\n", *cut)).otherwise(F.col(text))


def word_count(text: str = "text") -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
