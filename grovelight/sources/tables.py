"""Reading and checking binary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import quoted


def read_binary_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; the last column is the label.

    Without a schema the header line alone gives the names and every column is
    read as INT, so the data is scanned once, not twice as type inference would.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        names = reader.csv(path).columns
        schema = T.StructType([T.StructField(name, T.IntegerType()) for name in names])
    return reader.option("mode", "FAILFAST").csv(path, schema=schema)


def split_columns(df: DataFrame, features: Sequence[str] | None = None, label: str | None = None) -> tuple[list[str], str]:
    """Default column roles: the last column is the label, all others features."""
    label = label or df.columns[-1]
    features = list(features) if features is not None else [c for c in df.columns if c != label]
    return features, label


def check_columns(df: DataFrame, features: Sequence[str], label: str | None = None) -> None:
    """Raise before any job runs if the columns cannot be a binary table."""
    features = list(features)
    if not features:
        raise ValueError("at least one feature column is needed")
    if len(set(features)) != len(features):
        raise ValueError("feature columns repeat")
    if label is not None and label in features:
        raise ValueError(f"label {label!r} is also a feature")
    types = {field.name: field.dataType for field in df.schema.fields}
    for name in [*features, *([label] if label is not None else [])]:
        if name not in types:
            raise ValueError(f"column {name!r} not found")
        if not isinstance(types[name], (T.NumericType, T.BooleanType)):
            raise ValueError(f"column {name!r} is {types[name].simpleString()}, expected a number or boolean")


def truth(df: DataFrame, name: str) -> str:
    """Any nonzero value is true; NULL is not a value a binary table may hold."""
    return f"coalesce({bit(df, name)}, cast(raise_error({null_message(name)}) AS int))"


def bit(df: DataFrame, name: str) -> str:
    """0 or 1; NULL stays NULL."""
    is_bool = isinstance(df.schema[name].dataType, T.BooleanType)
    return f"cast({quoted(name)} AS int)" if is_bool else f"cast({quoted(name)} <> 0 AS int)"


def null_message(name: str) -> str:
    text = f"NULL in column {name}".replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def binary_table(
    df: DataFrame, features: Sequence[str], label: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Project to 0/1 INT features (and label); other columns only if kept."""
    check_columns(df, features, label)
    columns = [*features, *([label] if label is not None else [])]
    return df.selectExpr(*map(quoted, keep), *(f"{truth(df, c)} AS {quoted(c)}" for c in columns))
