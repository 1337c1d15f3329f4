"""Token ids of documents in flat binary files.

A part holds `tokens-N.bin`, the ids of its documents as unsigned integers without any header, `offsets-N.bin`, 64-bit
positions of the documents' first ids within the part with the end as last entry, and `docs-N.bin`, their 64-bit ids.
Parts follow each other in ascending doc_id. `manifest` is a small Parquet table with one row for each part; its `base`,
the prefix sum of the parts before it, turns a position within a part into one within the corpus.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawork.llm.text import small_batches, steps

#: Bytes of words and their ids that a worker keeps, each word counted with its objects; the table is emptied when full.
CACHED_BYTES, WORD_BYTES = 80_000_000, 200
#: Bytes of text that are encoded in one step. A longer single text is a step of its own; where words are encoded by
#: themselves it is cut between words into parts of PART_CHARS.
STEP_BYTES, PART_CHARS = 500_000, 1_000_000
#: Documents in a batch that is read back.
BATCH_DOCS = 4096

#: Signs that may stand behind a run of letters; not the apostrophe, with which contractions start.
_SIGNS = '!"#$%&()*+,./:;<=>?@[\\]^_`{|}~-'

_MANIFEST = "part int, docs long, tokens long, null_ids long, width int"


def _encoder(tokenizer: str, end_id: int, kind: str, way: str = "cores"):
    """Texts to the bytes of their ids, in one of three ways.

    "whole" asks the tokenizers library for every whole text. "words" is for tokenizers that drop white space and never
    join what it separates, so that a text's ids are those of its words put together; each worker asks for a word once
    and keeps the answer. With "cores" a word of letters and signs behind them is looked up in these two parts, and new
    letter runs are encoded in one text, in which tokens that end a word tell them apart.
    """
    by_core = way == "cores"
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer)
    code, wide = {2: "H", 4: "I"}[np.dtype(kind).itemsize], np.dtype(kind).itemsize
    known: dict[str, bytes] = {}
    end = array(code, [end_id]).tobytes()

    def whole_texts(texts: list[str]) -> list[bytes]:
        coded = model.encode_batch_fast(texts, add_special_tokens=False)
        return [array(code, one.ids).tobytes() + end for one in coded]

    if way == "whole":
        return whole_texts
    held = 0
    ends_word = np.zeros(model.get_vocab_size(with_added_tokens=True), bool)
    ends_word[[i for token, i in model.get_vocab().items() if token.endswith("</w>")]] = True

    def each(words: list[str]) -> dict[str, bytes]:
        coded = model.encode_batch_fast(words, add_special_tokens=False)
        return {word: array(code, one.ids).tobytes() for word, one in zip(words, coded)}

    def together(words: list[str]) -> dict[str, bytes]:
        ids = np.array(model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, kind)
        last = np.flatnonzero(ends_word[ids]) + 1
        if len(last) != len(words):
            return each(words)
        raw, to = ids.tobytes(), (last * wide).tolist()
        return {word: raw[x:y] for word, x, y in zip(words, [0, *to[:-1]], to)}

    def plain(text: str) -> bool:
        """Whether lower-casing first changes nothing: no special token, no sigma, no signs to be put together."""
        return "<" not in text and (text.isascii() or ("\u03a3" not in text and is_normalized("NFC", text)))

    def learn(new: set[str]) -> None:
        whole, signed = [], []
        runs: set[str] = set()
        for word in new:
            core = word.rstrip(_SIGNS) if by_core else ""
            if core.isalpha() and core.islower() and (core.isascii() or is_normalized("NFC", core)):
                runs.add(core)
                if core != word:
                    signed.append((word, core, word[len(core) :]))
            else:
                whole.append(word)
        if runs := runs.difference(known):
            known.update(together(list(runs)))
        if whole := list({signs for _, _, signs in signed}.union(whole).difference(known)):
            known.update(each(whole))
        known.update([(word, known[core] + known[signs]) for word, core, signs in signed])

    def encoded(texts: list[str]) -> list[bytes]:
        nonlocal held
        if held > CACHED_BYTES:
            known.clear()
            held = 0
        pieces = [(text.lower() if by_core and plain(text) else text).replace("\n", " ").split(" ") for text in texts]
        coded = [list(map(known.get, words)) for words in pieces]
        new = {word for words, found in zip(pieces, coded) if None in found for word, ids in zip(words, found) if ids is None}
        if new:
            before = len(known)
            learn(new)
            held += WORD_BYTES * (len(known) - before) + sum(map(len, new))
            get = known.__getitem__
            coded = [list(map(get, words)) if None in found else found for words, found in zip(pieces, coded)]
        return [b"".join(found) for found in coded]

    def in_parts(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS:
            gaps = [g for g in (text.find(" ", at + PART_CHARS), text.find("\n", at + PART_CHARS)) if g >= 0]
            if not gaps:
                break
            yield text[at : min(gaps)]
            at = min(gaps) + 1
        yield text[at:]

    def encode(texts: list[str]) -> list[bytes]:
        if max(map(len, texts), default=0) <= PART_CHARS:
            return [ids + end for ids in encoded(texts)]
        return [b"".join(encoded([part])[0] for part in in_parts(text)) + end for text in texts]

    return encode


#: Texts in which the ways to encode differ if they do anywhere.
_PROBE = (
    "Words, words and WORDS!! x.y a-b it's don't'' 12a a12 [x] (y) a_b ein größer, Été été. naïve%%% a'' 's", "a" * 40 + ",,, ," * 3,
    "Hello world  two  spaces\n\nlines\tand tabs ", " leading and trailing ", "日本語 テキスト，中文。 <s> </s> [UNK] <|endoftext|>", "",
)


def _fastest_way(tokenizer: str) -> str:
    """The quickest way that gives the ids of whole texts for the probe."""
    wanted = _encoder(tokenizer, 1, "<u4", "whole")(list(_PROBE))
    return next((way for way in ("cores", "words") if _encoder(tokenizer, 1, "<u4", way)(list(_PROBE)) == wanted), "whole")


def _writer(folder: str, tokenizer, end_id: int, kind: str, way: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, path = fs.FileSystem.from_uri(folder)
        names = [f"{path}/{name}-{part:06d}.bin" for name in ("tokens", "offsets", "docs")]
        encode, files, at, null_ids = None, [], 0, 0
        docs = 0
        for batch in steps(batches, step=STEP_BYTES):
            if encode is None:
                encode = _encoder(tokenizer.value, end_id, kind, way)
                files = [store.open_output_stream(f"{name}.{attempt}") for name in names]
            coded = encode(batch.column("text").to_pylist())
            files[0].write(b"".join(coded))
            sizes = np.array([len(x) for x in coded], np.int64) // np.dtype(kind).itemsize
            files[1].write((at + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
            ids = batch.column("doc_id")
            null_ids += ids.null_count
            files[2].write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            at += int(sizes.sum())
            docs += len(coded)
        if not docs:
            return
        files[1].write(np.array([at], "<i8").tobytes())
        for file, name in zip(files, names):
            file.close()
            store.move(f"{name}.{attempt}", name)  # a repeated task puts the same bytes in the same place
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (docs, at, null_ids)),
             pa.array([np.dtype(kind).itemsize], pa.int32())],
            ["part", "docs", "tokens", "null_ids", "width"],
        )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Encode every whole text and write the files by any tokenizer of the tokenizers library; returns the manifest (part, docs, tokens, null_ids, width, base).

    `folder` must be one that all executors reach. Documents follow each other in ascending doc_id, null ids first and
    repeated ids by text; null texts are empty and hold the end id alone. Ids take 16 bits where the vocabulary allows
    it, else 32. Texts are dealt by ranges of doc_id and sorted within them; a task streams its part to a file of its
    own, which takes its final name when it is whole, so repeated or doubled tasks do no harm. An empty table gives an
    empty manifest. Columns other than doc_id and text are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        tokenizer = file.read()
    largest = max(Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id)
    kind = "<u2" if largest < 2**16 else "<u4"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select(F.col("doc_id").cast("long"), text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shared = spark.sparkContext.broadcast(tokenizer)
    with small_batches(spark):
        ordered.mapInArrow(_writer(folder, shared, end_id, kind, _fastest_way(tokenizer)), _MANIFEST).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(_MANIFEST).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")
    parts.select("*", base).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _ids_of(store, name: str, kind: str) -> np.ndarray:
    """The numbers of a file; mapped into memory where the file is local."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), kind)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for row in (row for batch in batches for row in batch.to_pylist()):
            tokens, offsets, docs = (
                _ids_of(store, f"{path}/{name}-{row['part']:06d}.bin", kind)
                for name, kind in (("tokens", f"<u{row['width']}"), ("offsets", "<i8"), ("docs", "<i8"))
            )
            for a in range(0, row["docs"], BATCH_DOCS):
                b = min(a + BATCH_DOCS, row["docs"])
                bounds = np.array(offsets[a : b + 1])
                own = np.asarray(tokens[bounds[0] : bounds[-1]]).astype("<u4")
                local = bounds - bounds[0]
                sums = [zlib.crc32(own[x:y]) for x, y in zip(local[:-1].tolist(), local[1:].tolist())]
                ids = np.array(docs[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=np.arange(a, b) < row["null_ids"]), pa.array(bounds[:-1] + row["base"]),
                        pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array([row["part"]] * (b - a), pa.int32()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of the corpus before it), n_tokens, ids_crc32 (as 32-bit ids), part."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition("part").mapInArrow(
        _reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, part int"
    )
