"""Nested documents as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_document(frame: DataFrame, keys: list[str], column: str = "document") -> DataFrame:
    """All columns but the keys as one JSON text; missing parts are written as null."""
    parts = [name for name in frame.columns if name not in keys]
    return frame.select(
        *keys, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias(column)
    )


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)
