"""URL rules looked up in a cascade of Bloom filters.

Keys are host and path prefixes such as `example.com/en/`. Level 0 of a cascade holds the listed keys; level 1 the keys
of the corpus that pass it by mistake; level 2 the listed keys that pass level 1, and so on, until nobody passes by
mistake. Since the levels were built over every key of the corpus, a lookup of such a key is exact, and URLs are judged
without joining them with the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import constants, mixed, stored

#: Bits of one filter at most, 32 MB; a longer list is split by a hash into parts with a cascade each.
MOST_BITS = 2**28
#: Levels at which a cascade is given up; each level passes half of its predecessor's mistakes at most.
MOST_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first `://` up to `/`, `?`, `#`, with A-Z lower-cased; then up to `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(lengths: list[int]) -> Column:
    """Every rule that could fit a row's host and path, longest first: each domain suffix with each path prefix of a listed length."""
    suffixes = F.expr(
        "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    )
    prefixes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.concat(s, F.col("path").substr(F.lit(1), n))))
    )
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("short"), k.alias("key"))))
    return F.array_distinct(F.transform(ordered, lambda k: k["key"]))


def _bits_of(first: np.ndarray, second: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
    """Probes of every key, one row each, by double hashing; each level mixes the hashes anew."""
    salt = constants(2, 1000 + level)
    start, stride = mixed(first.view(np.uint64) ^ salt[0]), mixed(second.view(np.uint64) ^ salt[1]) | np.uint64(1)
    return np.stack([((start + np.uint64(k) * stride) >> np.uint64(17)) % np.uint64(bits) for k in range(probes)])


def _passes(filters, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Number of levels, from level 0 on, that each key passes without a break."""
    passed = np.zeros(len(first), np.int64)
    open_keys = np.arange(len(first))
    for level, (bits, probes, table) in enumerate(filters):
        if not len(open_keys):
            break
        at = _bits_of(first[open_keys], second[open_keys], level, bits, probes)
        inside = ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        open_keys = open_keys[inside]
        passed[open_keys] += 1
    return passed


def _level_bits(level: int, bits: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits_of(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), level, bits, probes))
            byte, start = np.unique(at >> np.uint64(3), return_index=True)
            if len(at):
                value = np.bitwise_or.reduceat(np.left_shift(1, (at & np.uint64(7)).astype(np.int64)), start)
                yield pa.RecordBatch.from_arrays([pa.array(byte.astype(np.int64)), pa.array(value)], ["byte", "bits"])

    return run


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _survivors(keys: DataFrame, filters) -> DataFrame:
    """The keys that pass all levels so far."""
    shared = keys.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = _passes(shared.value, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            yield batch.filter(pa.array(passed == len(shared.value)))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """Filters (bits, probes, bytes) that tell the keys of `listed` from the other keys of `universe` (column key) exactly.

    Both hold distinct keys. Level 0 lets about as many other keys pass as there are listed ones, however large the
    universe is, and each further level half of what it is asked, so the whole takes a few bits for each listed key times
    the logarithm of the ratio. Only finished filters reach the driver, at most MOST_BITS each; longer lists are to be
    split first. Null keys are not listed and never match.
    """
    listed = stored(_hashed(listed.filter("key is not null").distinct()), "listed")
    others = stored(_hashed(universe.join(listed, "key", "left_anti").filter("key is not null")), "others")
    inside, outside = listed, others
    n_inside, n_outside = listed.count(), others.count()
    filters: list[tuple[int, int, np.ndarray]] = []
    while n_inside:
        rate = min(0.5, n_inside / max(1, n_outside)) if not filters else 0.5
        probes = max(1, min(30, round(-np.log2(rate))))
        bits = int(min(MOST_BITS, max(64, np.ceil(n_inside * probes / np.log(2)))))
        bytes_of = inside.mapInArrow(_level_bits(len(filters), bits, probes), "byte long, bits long")
        table = np.zeros(bits // 8 + 1, np.uint8)
        fetched = bytes_of.groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
        table[fetched.column("byte").to_numpy()] = fetched.column("bits").to_numpy()
        filters.append((bits, probes, table))
        if not n_outside:
            break
        passed = stored(_survivors(outside, filters), "passed")
        outside, inside = inside, passed
        n_outside, n_inside = n_inside, passed.count()
        if len(filters) > MOST_LEVELS:
            raise ValueError("two keys share both hashes, so no cascade can tell them apart")
    return filters


def split_cascades(listed: DataFrame, universe: DataFrame) -> list[list[tuple[int, int, np.ndarray]]]:
    """One cascade, or several over hash parts of the keys if the list is too long for one filter."""
    parts = -(-listed.count() * 32 // MOST_BITS) or 1
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts))
    return [build_cascade(listed.filter(part == k), universe.filter(part == k)) for k in range(parts)]


def _listed_in(cascades: list) -> Column:
    """For a row's array of keys, which of them are listed; a key is, if an odd number of levels lets it pass."""
    parts = len(cascades)

    @F.arrow_udf("array<boolean>")
    def listed(first: pa.Array, second: pa.Array, part: pa.Array) -> pa.Array:
        h1, h2, own = (x.values.to_numpy(zero_copy_only=False) for x in (first, second, part))
        found = np.zeros(len(h1), bool)
        for k in range(parts):
            there = np.flatnonzero(own == k)
            found[there] = _passes(shared.value[k], h1[there], h2[there]) % 2 == 1
        return pa.ListArray.from_arrays(first.offsets, pa.array(found))

    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(cascades)
    return listed(
        F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)),
        F.transform("keys", lambda k: F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))),
    )


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge URLs by `rules` (host, path, verdict allow or block): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits wins, and of a rule
    listed with both verdicts, block. `rule` is its host and path, null if none fits; then the verdict is allow. Two
    cascades are asked, one of all rules and one of the blocking ones; their universe is every host suffix and path
    prefix of the pages. URLs that are null or without `://` have an empty host and path and no rule. Null rules are
    ignored. Repeated pages are judged each. Extra columns are ignored.
    """
    named = rules.filter("host is not null and path is not null").select(F.concat("host", "path").alias("key"), "verdict")
    lengths = [row.n for row in rules.select(F.length("path").alias("n")).filter("n is not null").distinct().orderBy("n").collect()]
    host, path = url_parts(F.col("url"))
    keyed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("keys", candidate_keys(lengths) if lengths else F.lit(None).cast("array<string>"))
    universe = stored(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    every = split_cascades(named.select("key").distinct(), universe)
    blocked = split_cascades(named.filter("verdict = 'block'").select("key").distinct(), universe)
    keyed = keyed.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    asked = keyed.withColumn("known", _listed_in(every)).withColumn("rule", F.expr("try_element_at(filter(keys, (k, i) -> known[i]), 1)"))
    asked = asked.withColumn("keys", F.when(F.col("rule").isNull(), F.array().cast("array<string>")).otherwise(F.array("rule")))
    asked = asked.withColumn("bad", F.coalesce(F.try_element_at(_listed_in(blocked), F.lit(1)), F.lit(False)))
    return asked.select(
        "page_id", "host", "path", "rule", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict")
    )
