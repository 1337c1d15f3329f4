"""Joins of a large table with a reference table: lookup with a default key, star flattening, orphans.

A reference table is broadcast only after its size was measured. Beyond the bound the join shuffles and Spark splits the
partitions of hot keys at run time. Which of the two happens never changes the result: keys of different types are
widened to a common type first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    CharType,
    DataType,
    DecimalType,
    FractionalType,
    MapType,
    NumericType,
    StringType,
    StructField,
    StructType,
    VarcharType,
    VariantType,
)

from ..functions import surrogate_key
from .evolve import digits, relaxed

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """The size of a table in memory: rows times fixed widths plus the bytes of its texts (action)."""
    fixed, texts = 16, []
    for field in df.schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            fixed += 16
            texts.append(F.coalesce(F.sum(F.octet_length(field.name)), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            fixed += 16
            texts.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(field.name)))), F.lit(0)))
        else:
            fixed += 16
    rows, *sizes = df.agg(F.count(F.lit(1)), *texts).first()
    return rows * fixed + sum(sizes)


def common_type(df: DataFrame, left: DataType, right: DataType) -> DataType:
    """The type in which keys of two types are compared without losing digits.

    Text against anything else is compared as text, so '01' is not 1. Binary fractions have no exact common type with
    integers and decimals, and are refused. Integers and decimals that no decimal of 38 digits holds together are compared
    by their whole part and their fraction, a struct of two decimals.
    """
    texts = (StringType, CharType, VarcharType)
    if isinstance(left, texts) or isinstance(right, texts):
        return StringType()
    if left == right:
        return left

    def binary(kind: DataType) -> bool:
        return isinstance(kind, FractionalType) and not isinstance(kind, DecimalType)

    if isinstance(left, NumericType) and isinstance(right, NumericType) and binary(left) != binary(right):
        raise ValueError(f"keys of {left.simpleString()} and {right.simpleString()} can't be compared exactly")
    a, b = digits(left), digits(right)
    if a and b and max(a[0], b[0]) + max(a[1], b[1]) > 38:
        return _PARTS
    widened = F.coalesce(F.lit(None).cast(left), F.lit(None).cast(right)).alias("k")
    return df.sparkSession.range(0).select(widened).schema["k"].dataType


#: A number as its whole part and its fraction.
_PARTS = StructType([StructField("whole", DecimalType(38, 0)), StructField("fraction", DecimalType(38, 38))])


def as_key(column: str, kind: DataType) -> Column:
    """A key in the type of `common_type`."""
    if kind != _PARTS:
        return F.col(column).cast(kind)
    fraction = F.col(column) % F.lit(1).cast("decimal(1,0)")
    parts = F.struct(
        (F.col(column) - fraction).cast("decimal(38,0)").alias("whole"), fraction.cast("decimal(38,38)").alias("fraction")
    )
    return F.when(F.col(column).isNotNull(), parts)


def join_reference(
    large: DataFrame,
    reference: DataFrame,
    on: list[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    known_bytes: int | None = None,
) -> DataFrame:
    """Join on equal columns; broadcast the reference if it fits, else shuffle.

    Only for left, inner, left_semi and left_anti joins, the ones in which the large side alone decides where a hot key
    is split. The key columns keep the types of the large side. `known_bytes` is the size of the reference where the
    caller has it already; otherwise its plan is run once more to measure it, so write it to a table first if it is
    expensive to compute.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"not a reference join: {how}")
    kinds = {c: common_type(large, large.schema[c].dataType, reference.schema[c].dataType) for c in on}
    wide = {c: f"_wide_{c}" for c, kind in kinds.items() if not large.schema[c].dataType == reference.schema[c].dataType == kind}
    fits = (measured_bytes(reference) if known_bytes is None else known_bytes) <= max_bytes
    left = large.withColumns({wide[c]: as_key(c, kinds[c]) for c in wide})
    right = reference.withColumns({wide[c]: as_key(c, kinds[c]) for c in wide}).drop(*wide)
    joined = left.join(F.broadcast(right) if fits else right, [wide.get(c, c) for c in on], how).drop(*wide.values())
    others = [] if how in ("left_semi", "left_anti") else [c for c in reference.columns if c not in on]
    return joined.select(*on, *[c for c in large.columns if c not in on], *others)


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: str | dict[str, str],
    key: str,
    default: object = "-2",
    alias: str | None = None,
    **join_options: int,
) -> DataFrame:
    """Add the key of a dimension to a fact; a business key without a match gets `default`.

    `on` is the business key, or {fact column: dimension column}. The dimension must be unique on it.
    """
    pairs = {on: on} if isinstance(on, str) else on
    alias = alias or key
    side = dim.select(*[F.col(d).alias(f"_lk_{f}") for f, d in pairs.items()], F.col(key).alias("_lk_key"))
    for f in pairs:
        side = side.filter(F.col(f"_lk_{f}").isNotNull())
    keyed = fact.select("*", *[F.col(f).alias(f"_lk_{f}") for f in pairs])
    joined = join_reference(keyed, side, [f"_lk_{f}" for f in pairs], "left", **join_options)
    return joined.select(
        *fact.columns, F.coalesce("_lk_key", F.lit(default).cast(dim.schema[key].dataType)).alias(alias)
    )


def build_fact(
    df: DataFrame,
    key: str,
    grain: list[str],
    lookups: list[tuple[DataFrame, str | dict[str, str], str]],
    columns: list[Column | str],
    default: object = "-2",
    sizes: dict[str, int] | None = None,
    **join_options: int,
) -> DataFrame:
    """A fact: its surrogate key over the grain, a key per looked-up dimension, and the other columns.

    `lookups` is a list of (dimension, business key, dimension key); see `lookup`. The fact itself is
    hashed and projected in place, each small dimension is one broadcast. `sizes` gives the bytes of
    dimensions, by dimension key, that were measured before.
    """
    business = [f for _, on, _ in lookups for f in ([on] if isinstance(on, str) else on)]
    others = df.select(*columns).columns
    fact = df.select(surrogate_key(*grain).alias(key), *[F.col(b).alias(f"_bk_{b}") for b in business], *columns)
    for dim, on, dim_key in lookups:
        pairs = {on: on} if isinstance(on, str) else on
        named = {f"_bk_{f}": d for f, d in pairs.items()}
        fact = lookup(fact, dim, named, dim_key, default, known_bytes=(sizes or {}).get(dim_key), **join_options)
    return fact.select(key, *[dim_key for _, _, dim_key in lookups], *others)


def flatten_star(
    fact: DataFrame,
    dims: list[tuple[DataFrame, str, list[str]]],
    sizes: dict[str, int] | None = None,
    **join_options: int,
) -> DataFrame:
    """One flat row per fact row: each (dimension, key, attributes) replaces the key by the attributes."""
    flat = fact
    for dim, key, attributes in dims:
        side, known = dim.select(key, *attributes), (sizes or {}).get(key)
        flat = join_reference(flat, side, [key], "inner", known_bytes=known, **join_options).drop(key)
    return flat


def all_rows(table: DataFrame) -> Column:
    """The rows of a code table as one array of structs: a scalar subquery, so nothing is joined or fetched."""
    row = F.struct(*[F.col(c) for c in table.columns])
    return table.agg(F.collect_list(row).alias("rows")).scalar()


def with_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Every row with every code, expanded in place from the list of codes."""
    return df.select("*", F.inline(all_rows(codes)))


def reconcile_keys(produced: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side knows: declared but not produced is an error, the reverse a warning.

    Both sides are tagged and grouped together: one scan each, one shuffle of distinct keys.
    """
    made = produced.select(*keys, F.lit(True).alias("_made"), F.lit(False).alias("_wanted"))
    wanted = declared.select(*keys, F.lit(False).alias("_made"), F.lit(True).alias("_wanted"))
    known = [F.bool_or(side).alias(side) for side in ("_made", "_wanted")]
    one_sided = made.unionByName(wanted).groupBy(*keys).agg(*known).filter(F.col("_made") != F.col("_wanted"))
    return one_sided.select(*keys, F.when(F.col("_wanted"), "error").otherwise("warn").alias("severity"))


#: Ranges that a level of digests cuts each range of the level above into, and the levels.
DIGEST_RANGES, DIGEST_LEVELS = 1024, 2


def reconcile_by_digest(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None, ranges: int = DIGEST_RANGES, levels: int = DIGEST_LEVELS
) -> DataFrame:
    """Keys whose rows differ between two large tables: the keys, left_rows, right_rows, and status (action).

    Status is `missing` (only right has the key), `extra` (only left has it) or `changed`. `columns` are compared, all
    common ones if not given; of the same name and type on both sides. Each level cuts ranges of the key's hash into
    digests of their rows, which do not depend on the rows' order: their number and the sums of two hashes. Only
    ranges whose digests differ are cut again, and only rows of ranges that differ at last are shuffled by key, so what
    is alike costs one pass for each level and no shuffle. Repeated rows count; NULL in a key or column is a value.
    """
    columns = [c for c in left.columns if c in right.columns] if columns is None else columns
    for c in [*keys, *columns]:
        if relaxed(left.schema[c].dataType) != relaxed(right.schema[c].dataType):
            raise ValueError(f"{c} has two types")
    rest = [c for c in columns if c not in keys]

    def hashed(df: DataFrame, side: int) -> DataFrame:
        values = [*keys, *rest]
        absent = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in values])
        row = [F.xxhash64(F.lit(seed), *values, absent) for seed in (1, 2)]
        place = F.pmod(F.xxhash64(F.lit(3), *keys), F.lit(ranges**levels))
        return df.select(*keys, F.lit(side).alias("_side"), place.alias("_place"), row[0].alias("_a"), row[1].alias("_b"))

    def halves(name: str) -> list[Column]:
        """Sums that can't overflow: of the upper and the lower half of a hash."""
        return [F.sum(F.shiftright(name, 32)), F.sum(F.col(name).bitwiseAND(0xFFFFFFFF))]

    rows = hashed(left, 0).unionByName(hashed(right, 1))
    for level in range(1, levels + 1):
        part = F.floor(F.col("_place") / ranges ** (levels - level)).alias("_part")
        digest = rows.groupBy(part, "_side").agg(F.struct(F.count("*"), *halves("_a"), *halves("_b")).alias("digest"))
        both = digest.groupBy("_part").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        differing = sorted(r["_part"] for r in both.filter("n < 2 or low != high").select("_part").collect())  # ranges ** level at most
        if not differing:
            return _differences(rows.limit(0), keys)
        listed = rows.sparkSession.createDataFrame([(x,) for x in differing], "_part long")
        rows = rows.withColumn("_part", part).join(F.broadcast(listed), "_part", "left_semi").drop("_part")
    return _differences(rows, keys)


def _differences(rows: DataFrame, keys: list[str]) -> DataFrame:
    def on(side: int, value: Column) -> Column:
        return F.when(F.col("_side") == side, value)

    def sums(side: int) -> Column:
        parts = [F.sum(on(side, h)) for name in ("_a", "_b") for h in (F.shiftright(name, 32), F.col(name).bitwiseAND(0xFFFFFFFF))]
        return F.array(*[F.coalesce(x, F.lit(0)) for x in parts])

    counted = rows.groupBy(*keys).agg(
        F.count(on(0, F.lit(1))).alias("left_rows"), F.count(on(1, F.lit(1))).alias("right_rows"), sums(0).alias("_l"), sums(1).alias("_r")
    )
    status = F.when(F.col("left_rows") == 0, "missing").when(F.col("right_rows") == 0, "extra").otherwise("changed")
    return counted.filter("_l != _r or left_rows != right_rows").select(*keys, "left_rows", "right_rows", status.alias("status"))
