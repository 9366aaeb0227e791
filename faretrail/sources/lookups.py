"""Lookup tables opened by name, from the session's catalog or from a folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lookup tables, and the columns that the joins read.
LOOKUPS: Mapping[str, T.StructType] = {
    "operators": T.StructType().add("participantid", T.IntegerType()).add("participantname", T.StringType()),
    "routes": T.StructType().add("routeid", T.IntegerType()).add("participantid", T.IntegerType()).add("routename", T.StringType()),
    "locations": T.StructType().add("locationcode", T.IntegerType()).add("participantid", T.IntegerType()).add("locationname", T.StringType()),
}


def _open(spark: SparkSession, source: str | None, name: str) -> DataFrame:
    if source is not None and "/" in source:
        for path in (f"{source.rstrip('/')}/{name}", f"{source.rstrip('/')}/{name}.parquet"):
            try:
                return spark.read.parquet(path)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        raise ValueError(f"no table {name} in {source}")
    table = f"{source}.{name}" if source else name
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no table {table} in the session's catalog")
    return spark.table(table)


def _checked(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """The table's declared columns in their types, then its others; whole numbers of any width count as integers."""
    given = {f.name.lower(): f.dataType for f in df.schema.fields}
    wrong = []
    for f in schema.fields:
        kind = given.get(f.name.lower())
        fits = isinstance(kind, T.IntegralType) if isinstance(f.dataType, T.IntegralType) else isinstance(kind, type(f.dataType))
        if not fits:
            wrong.append(f"{f.name} {f.dataType.simpleString()} ({'missing' if kind is None else kind.simpleString()})")
    if wrong:
        raise ValueError(f"table {name}: {', '.join(wrong)}")
    declared = {f.name.lower() for f in schema.fields}
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields],
                     *[f"`{c}`" for c in df.columns if c.lower() not in declared])


def open_tables(spark: SparkSession, source: str | None = None, schemas: Mapping[str, T.StructType] = LOOKUPS) -> dict[str, DataFrame]:
    """The named tables of ``source``, lazily: a folder (it has a slash; Parquet folders or files by name), a
    database of the session's catalog, or its current database and temporary views (``None``).

    A table that is not there, lacks a declared column or has it in another
    kind of type raises ``ValueError`` before anything runs.
    """
    return {name: _checked(_open(spark, source, name), name, schema) for name, schema in schemas.items()}
