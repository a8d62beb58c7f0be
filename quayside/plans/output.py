"""Final presentation step of a registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def as_output(df: DataFrame) -> DataFrame:
    """Cast exact decimals to double at the very end (values already rounded)."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        cols.append(c.cast("double").alias(field.name) if isinstance(field.dataType, DecimalType) else c)
    return df.select(*cols)
