"""Dimensions: hashed key plus the members that stand for empty, unknown and not applicable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_key


def dimension(business: DataFrame, key: str, business_key: str) -> DataFrame:
    """The business rows with a hashed surrogate key in front."""
    return business.select(hash_key(business_key).alias(key), "*")


def with_unknown_members(
    dim: DataFrame, unknown: DataFrame, key: str, mapping: dict[str, Column], id_col: str = "unknown_id"
) -> DataFrame:
    """The dimension plus one row per unknown member.

    The member's id is its key (in the dimension's key type). `mapping` says which expression over
    the unknown table fills an attribute; an attribute that is not mapped is NULL.
    """
    fields = dim.schema
    members = unknown.select(
        *[
            (F.col(id_col) if f.name == key else mapping.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
    return dim.unionByName(members)
