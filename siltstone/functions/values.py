"""JSON objects, vectors as bytes, names and references as Column expressions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(value: str | None) -> str | None:
    def refuse(name: str):
        raise ValueError(name)

    try:
        found = json.loads(value, parse_constant=refuse) if value is not None else None
    except ValueError:
        return None
    return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) if isinstance(found, dict) else None


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """A JSON object with sorted keys and no spaces; null for anything else, NaN and infinities included."""
    return pd.Series([_canonical(v) for v in values], dtype=object)


def is_json_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in vectors], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_vector(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.frombuffer(v, dtype="<f4") for v in values], dtype=object)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, position by position; zeros if there are none."""
    kept = F.filter(F.zip_with(hidden, mask, lambda h, m: F.struct(h.alias("h"), m.alias("m"))), lambda x: x["m"] == 1)
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["h"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def safe_filename(stored: Column) -> Column:
    """The last part of a stored name; null for names that are empty or lead out of a folder."""
    name = F.regexp_extract(F.replace(stored, F.lit("\\"), F.lit("/")), r"[^/]*$", 0)
    return F.when(~name.isin("", ".", "..") & ~F.contains(name, F.lit("\u0000")), name)


def block_id_of_ref(ref: Column) -> Column:
    """#/texts/1 as texts_1."""
    return F.replace(F.regexp_replace(ref, "^#?/", ""), F.lit("/"), F.lit("_"))


def page_of_message(message: Column) -> Column:
    """The page number that an error message names, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(message, r"(?i)\bpage\s+(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def utc_seconds(time: Column) -> Column:
    """ISO 8601 with seconds, in UTC; pass the time, so that a plan gives the same result again."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def embedding_text(heading_path: Column, text: Column) -> Column:
    """What is embedded for a chunk: its heading path, then its text."""
    return F.concat_ws("\n", F.when(heading_path != "", heading_path), text)
