"""Epoch seconds of timestamps with or without a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('SECOND', {column}))")
    return F.unix_seconds(column)
