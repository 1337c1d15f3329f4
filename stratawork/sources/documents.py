"""Large JSON documents, read by tasks that each hold a part of one."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks need not have the library installed

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_HEADS = (rf"\s*[\[{{]\s*((?:{_STRING}\s*:\s*)?[\[{{])", rf"\s*((?:{_STRING}\s*:\s*)?[\[{{])")
_MEASURED = "file string, start bigint, odd int, outside bigint, inside bigint"
_CUT = "block bigint, k bigint, at int, ends int, head string, edge boolean, text string"

_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1


def _steps(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: the byte, how it changes the depth, and whether the quotes up to it are odd in number."""
    if b"\\" in data:
        data = re.sub(rb"(?s)\\.", b"__", data)
    codes = np.frombuffer(data, np.uint8)
    return codes, _STEP[codes], np.cumsum(codes == 34, dtype=np.uint8) & 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a file: whether its quotes are odd, and its change of depth if it begins outside or inside of a string."""
    block, odd, change = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "start", "odd", "outside", "inside"), (*block, odd, *change)))], _schema(_MEASURED))

    for batch in batches:
        starts, files = batch.column("start").to_numpy(), batch.column("file")
        texts = batch.column("value").cast(pa.binary()).to_pylist()
        same = files.slice(1).to_numpy(zero_copy_only=False) == files.slice(0, len(files) - 1).to_numpy(zero_copy_only=False)
        for a, b in pairwise([0, *(np.flatnonzero((np.diff(starts) != 0) | ~same) + 1), len(texts)]):
            if block != (here := (files[a].as_py(), int(starts[a]))):
                if block:
                    yield row()
                block, odd, change = here, 0, [0, 0]
            _, steps, inside = _steps(b",".join(texts[a:b]))
            if len(inside):
                both = [int(steps[inside == x].sum(dtype=np.int64)) for x in (odd, 1 - odd)]
                change, odd = [x + y for x, y in zip(change, both)], odd ^ int(inside[-1])
    if block:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each block, cut at the commas between the members of a document or of one of its members.

    k counts a block's cuts, text before the first one belongs to what an earlier block began; at and ends are the depths
    where a member begins and ends, head the text that opened the object it is in, as far as the block has it. Only the
    member that is being read is held.
    """
    heads, names = [re.compile(x.encode(), re.S) for x in _HEADS], ("block", "k", "at", "ends", "head", "edge", "text")
    block, k, at, depth, odd, head, parts, out = None, 0, None, 0, 0, None, [], []

    def end(last: bool) -> None:
        nonlocal head, parts
        text, parts = b"".join(parts), []
        out.append((block, k, at, depth, head if at == 2 else None, last or not k, text))
        if at is not None and at < 2:
            found = heads[at].match(text)
            head = found[1] if found else b""

    def rows() -> pa.RecordBatch:
        columns = [list(x) for x in zip(*out)] or [[] for _ in names]
        out.clear()
        binary = [pa.array(x, pa.binary()).cast(pa.string()) if n in ("head", "text") else x for n, x in zip(names, columns)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(binary, _schema(_CUT))], names)

    for batch in batches:
        ids, texts = batch.column("block").to_numpy(), batch.column("value").cast(pa.binary()).to_pylist()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(ids)) + 1), len(texts)]):
            data = b"," + b",".join(texts[a:b])
            if ids[a] != block:
                if block is not None:
                    end(True)
                block, depth, odd, n = (batch.column(x)[a].as_py() for x in ("block", "depth", "odd", "n"))
                k, at, head = 0, None, None
                if batch.column("start")[a].as_py() == 0:  # no comma stands before the first text of a file
                    data = b"\n" + data[1:]
                    k, at = (1, 0) if n == 1 else (0, None)
            codes, steps, inside = _steps(data)
            inside = inside ^ odd
            depths = depth + np.cumsum(np.where(inside, 0, steps), dtype=np.int64)
            begin = 0
            for i in np.flatnonzero((codes == 44) & (inside == 0) & (depths <= 2)).tolist():
                parts.append(data[begin:i])
                depth = int(depths[i])
                if depth < 1:
                    raise ValueError("the document is no JSON: a comma stands outside of it")
                end(False)
                k, at, begin = k + 1, depth, i + 1
            parts.append(data[begin:])
            depth, odd = int(depths[-1]), int(inside[-1])
        yield rows()
    if block is not None:
        end(True)
        yield rows()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _closing(opening: Column) -> Column:
    return F.translate(F.right(opening, F.lit(1)), "{[", "}]")


def _plain(raw: Column) -> Column:
    """A name as JSON has it, without escapes."""
    return F.when(F.instr(raw, "\\") > 0, F.to_json(F.parse_json(raw))).otherwise(raw)


def read_json_members(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """Every JSON document, one for each file, member by member: file, document (text).

    Each row is the document with one member only: one of those of its top-level objects and arrays, or a top-level member
    that has none. Together they have what the whole document has. With `pieces` the files of a folder are the lines of one
    document, in order of their names, and file is the folder. A file that is no JSON fails, and one that repeats a name.

    No task holds a document. Tasks read blocks of the files (`spark.sql.files.maxPartitionBytes`) twice: the first time they
    count quotes and brackets, so that a sum over the blocks tells depth and quoting at each block's start; the second time
    they write the members to the shared folder. Members that cross blocks are put together by a grouping.
    """
    lines = spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    order = Window.partitionBy("document").orderBy("file", "start")
    before, all_of_it = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("document")
    earlier = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    blocks = (
        lines.mapInArrow(_measure, _MEASURED)
        .withColumn("document", F.regexp_replace("file", "/[^/]*$", "") if pieces else F.col("file"))
        .withColumns({"quotes": F.sum("odd").over(all_of_it), "n": F.row_number().over(order), "odd": (earlier("odd") % 2).cast("int")})
        .withColumn("change", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
        .withColumns({"closed": (F.sum("change").over(all_of_it) == 0) & (F.col("quotes") % 2 == 0), "depth": earlier("change")})
    )
    open_ended = F.raise_error(F.concat(F.lit("the document is no JSON, it does not end: "), "document"))
    blocks = blocks.select(
        F.monotonically_increasing_id().alias("block"), "document", "file", "start", "n", "odd",
        F.when(F.col("closed"), F.col("depth")).otherwise(open_ended.cast("bigint")).alias("depth"),
    )
    blocks.write.parquet(folder := new_folder(spark, "blocks"))
    blocks = spark.read.schema(blocks.schema).parquet(folder)

    # The blocks are few and broadcast: lines stay in the order of their file.
    placed = lines.join(F.broadcast(blocks), ["file", "start"]).select("block", "start", "n", "odd", "depth", "value")
    placed.mapInArrow(_cut, _CUT).write.parquet(folder := new_folder(spark, "members"))
    cut = spark.read.schema(_CUT).parquet(folder).join(F.broadcast(blocks.select("block", "document", "n")), "block")

    columns = ["document", "n", "k", "at", "ends", "head", "text"]
    crossing = cut.filter("edge").withColumn("member", F.count("at").over(Window.partitionBy("document").orderBy("n", "k")))
    place = F.struct("n", "k")
    crossing = crossing.groupBy("document", "member").agg(
        F.min(place).alias("place"), F.max("at").alias("at"), F.max_by("ends", place).alias("ends"), F.max("head").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    members = cut.filter("not edge").select(columns).unionByName(crossing.select("*", "place.*").select(columns))

    opens = F.when(F.col("at") == 0, F.regexp_extract("text", "^" + _HEADS[0], 1)).when(
        F.col("at") == 1, F.regexp_extract("text", "^" + _HEADS[1], 1)
    )
    last = members.filter("at <= 1").groupBy("document", "n").agg(F.max_by(opens, "k").alias("carried"))
    carried = blocks.join(last, ["document", "n"], "left").select(
        "document", "n", F.last("carried", ignorenulls=True).over(
            Window.partitionBy("document").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        ).alias("carried"),
    )
    root = members.filter("at = 0").select("document", F.regexp_extract("text", r"^\s*([\[{])", 1).alias("root"))
    members = members.join(F.broadcast(carried), ["document", "n"]).join(F.broadcast(root), "document")
    members = members.withColumn("head", F.coalesce(opens, "head", "carried"))
    _refuse_repeated(members.filter("root = '{'"))

    text, ends = F.col("text"), F.col("ends")
    # What is added to a member must not hide a comma too many.
    empty = ((F.col("at") > 0) & text.rlike(r"^\s*([}\]]|$)")) | ((ends > 0) & text.rlike(r"[{\[]\s*$"))
    front = F.when(F.col("at") == 0, "").when(F.col("at") == 1, F.col("root")).otherwise(F.concat("root", "head"))
    back = F.concat(F.when(ends > 1, _closing(F.col("head"))).otherwise(""), F.when(ends > 0, _closing(F.col("root"))).otherwise(""))
    no_json = F.raise_error(F.concat(F.lit("the document is no JSON, a member is empty: "), "document")).cast("string")
    return members.select(F.col("document").alias("file"), F.when(empty, no_json).otherwise(F.concat(front, "text", back)).alias("document"))


def _refuse_repeated(members: DataFrame) -> None:
    """Fail if a document has two members of one name, or one of its objects has."""
    name = rf"({_STRING})\s*:"
    outer = F.when(F.col("at") < 2, F.regexp_extract("text", rf"^\s*\{{?\s*{name}", 1)).otherwise("")
    start = [rf"^{head}\s*{name}" for head in _HEADS]
    inner = F.when(F.col("at") == 2, F.regexp_extract("text", rf"^\s*{name}", 1)).when(
        F.col("at") == 1, F.regexp_extract("text", start[1], 2)
    ).otherwise(F.regexp_extract("text", start[0], 2))
    group = F.regexp_extract("head", rf"^{name}", 1)
    names = members.select(outer.alias("outer"), inner.alias("inner"), group.alias("group"), "document", F.endswith("head", F.lit("{")).alias("object"))
    paths = F.array(
        F.when(F.col("outer") != "", F.array(_plain(F.col("outer")))),
        F.when((F.col("inner") != "") & F.col("object"), F.array(_plain(F.col("group")), _plain(F.col("inner")))),
    )
    found = names.select("document", F.explode(F.array_compact(paths)).alias("path")).groupBy("document", "path").count().filter("count > 1")
    if twice := found.first():
        raise ValueError(f"{twice.document}: {'.'.join(twice.path)} stands there twice")
