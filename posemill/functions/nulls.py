"""Missing values. Sources write NaN; here a missing value is NULL, so that comparisons and aggregates skip it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every double or float column with NaN replaced by NULL."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, kinds)})


def ensure_columns(df: DataFrame, wanted: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """df with every wanted column (name to type): a missing one is taken from its alias, or is NULL."""
    for name, kind in wanted.items():
        if name not in df.columns:
            other = (aliases or {}).get(name)
            df = df.withColumn(name, (F.col(other) if other in df.columns else F.lit(None)).cast(kind))
    return df


def holds(predicate: Column) -> Column:
    """A predicate on missing values does not hold: false, not unknown."""
    return F.coalesce(predicate, F.lit(False))


def mean_present(*values: Column) -> Column:
    """The mean of those values of a row that are present; NULL if none is."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present))


def to_number(value: Column) -> Column:
    """A double, or NULL for text that is no number."""
    return value.try_cast("double")
