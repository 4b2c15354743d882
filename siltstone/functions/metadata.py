"""JSON metadata: typed citation fields and equality filters that keep JSON's types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _typed(json: Column, key: str, kind: str, cast: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(value, "$", cast))


def citation(json: Column) -> list[Column]:
    """page_start, page_end, heading_path, source_filename, document_id; a value of another type is null."""
    ints = [_typed(json, k, "BIGINT", "int").alias(k) for k in ("page_start", "page_end")]
    return ints + [_typed(json, k, "STRING", "string").alias(k) for k in ("heading_path", "source_filename", "document_id")]


def where_equals(json: Column, where: dict[str, Any]) -> Column:
    """All keys equal. None matches a missing key or JSON null; 1, 1.0 and true are equal; "1" is not."""
    out = F.lit(True)
    for key, wanted in where.items():
        value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        if wanted is None:
            out = out & (kind == "VOID")
        elif isinstance(wanted, str):
            out = out & F.coalesce((kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted), F.lit(False))
        else:
            number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))
            out = out & F.coalesce(number == float(wanted), F.lit(False))
    return out
