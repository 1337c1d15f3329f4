"""Hashed keys for dimensions and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that stands for NULL inside a surrogate key, so NULL and '' differ.
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"


def hash_key(business_key: Column | str) -> Column:
    """SHA-1 of one business key as text, 40 hex characters; NULL stays NULL."""
    key = F.col(business_key) if isinstance(business_key, str) else business_key
    return F.sha1(key.cast("string"))


def surrogate_key(*parts: Column | str) -> Column:
    """MD5 of the parts as text joined by '-', 32 hex characters.

    Format timestamps with a fraction yourself (`date_format`): engines differ in trailing zeros.
    """
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL_TOKEN)) for p in parts]
    return F.md5(F.concat_ws("-", *texts))
