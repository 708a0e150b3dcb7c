"""CSV output that refuses to replace existing data by default."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_output(df: DataFrame, path: str, overwrite: bool = False, sort_by: list[str] | None = None) -> str:
    """Write a CSV folder named ``*.csv``, one part file per partition.

    Existing output raises unless ``overwrite``; other suffixes are rejected.
    """
    if not str(path).endswith(".csv"):
        raise ValueError(f"Unsupported output file type: {path}")
    out = df.orderBy(*sort_by) if sort_by else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(str(path))
    return str(path)
