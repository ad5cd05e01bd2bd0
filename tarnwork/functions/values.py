"""Values that built-in functions cannot make: Unicode forms, canonical JSON, vector digests."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: Column | str) -> Column:
    """NFKC, lower case, white space collapsed."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))

    return form(text)


def canonical_json(text: Column | str) -> Column:
    """JSON with sorted keys and no white space; null where it is not valid."""

    def canon(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(canon)

    return form(text)


def vector_fingerprint(vector: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the little-endian float32 components."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest()[:16])

    return form(vector)


def byte_prefix(text: Column | str, limit: int) -> Column:
    """The longest prefix of whole code points within ``limit`` bytes."""
    c = F.col(text) if isinstance(text, str) else text
    sizes = F.transform(F.split(F.left(c, F.lit(limit)), ""), lambda x: F.octet_length(x))
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"))
    # once a code point does not fit, the count of bytes is past the limit for good
    fit = F.aggregate(sizes, start, lambda s, x: F.struct((s["bytes"] + x).alias("bytes"), (s["n"] + (s["bytes"] + x <= limit).cast("int")).alias("n")), lambda s: s["n"])
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.substring(c, F.lit(1), fit))


def whole_json(text: Column | str) -> Column:
    """Whether a text, such as a cut prefix, is whole JSON by itself."""
    return F.try_parse_json(text).isNotNull()
