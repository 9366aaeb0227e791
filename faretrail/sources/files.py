"""File sources: transfer-rule CSV, pair-day transfer CSV, and the manifest of
monthly transfer/transaction files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_SCHEMA = T.StructType([
    T.StructField("from_AgencyName", T.StringType()),
    T.StructField("to_AgencyName", T.StringType()),
    T.StructField("max_time", T.IntegerType()),
])

PAIR_DAY_SCHEMA = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("CircadianDayOfWeek", T.IntegerType()),
    T.StructField("RandomWeekID", T.IntegerType()),
    T.StructField("to_AgencyName", T.StringType()),
    T.StructField("from_AgencyName", T.StringType()),
    T.StructField("sampled_transfers", T.IntegerType()),
    T.StructField("from_Agency_Sampled_Transactions", T.IntegerType()),
    T.StructField("to_Agency_Sampled_Transactions", T.IntegerType()),
    T.StructField("estimated_transfers", T.IntegerType()),
    T.StructField("estimated_from_agency_transactions", T.IntegerType()),
    T.StructField("estimated_to_agency_transactions", T.IntegerType()),
])

# File-type markers in manifest names and their pivot columns.
MANIFEST_TYPES = (("Transaction", "Transactions"), ("Transfer", "Transfers"))


def read_transfer_rules(spark: SparkSession, path: str) -> DataFrame:
    """Agency-pair rule CSV: header, single-quoted names, blanks after commas.

    The header is matched by position, so the padded header names do not
    matter; ``max_time`` is read as an integer (minutes).
    """
    return (
        spark.read.schema(RULES_SCHEMA)
        .option("header", True)
        .option("quote", "'")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_pair_day(spark: SparkSession, path: str) -> DataFrame:
    """Transfers-by-day-by-agency-pair CSV (12 columns, header)."""
    return spark.read.schema(PAIR_DAY_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def write_pair_day(db: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the pair-day transfer database as CSV with the 12 columns that :func:`read_pair_day` reads, in its order."""
    db.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAIR_DAY_SCHEMA.fields]).write.mode(mode).option("header", True).csv(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The data files under ``folder`` by Spark's own listing: ``name``, ``length``, ``modificationTime``; no content is read.

    A data set that Spark wrote (a folder of ``part-`` files) counts as one
    file of the folder's name, a partition folder ``key=value`` as one of the
    value; its length is the sum, its time the latest of its parts. Hidden files
    and markers are not listed, an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    steps = F.split("path", "/")
    name = F.when(F.element_at(steps, -1).startswith("part-"), F.element_at(steps, -2)).otherwise(F.element_at(steps, -1))
    name = F.regexp_replace(name, "^[A-Za-z_][A-Za-z0-9_]*=", "")
    # what Spark escapes in names of partition folders
    name = F.when(name.rlike("%[0-9A-F]{2}"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))


def file_manifest(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Pair monthly transaction and transfer files from their names.

    Year is characters 1-4 and month characters 8-9 of the name; the type is
    ``Transfers`` when the name contains "Transfer", else ``Transactions``
    when it contains "Transaction". Names of neither type are dropped. Files
    of one (year, month, type) are numbered in name order and the k-th
    transaction file is paired with the k-th transfer file.
    """
    n = F.col(name_col)
    kind = F.lit(None).cast("string")
    for marker, label in MANIFEST_TYPES:  # the later marker wins
        kind = F.when(n.contains(marker), F.lit(label)).otherwise(kind)
    typed = names.select(
        n.alias("name"),
        F.expr(f"try_cast(substring({name_col}, 1, 4) as int)").alias("year"),
        F.expr(f"try_cast(substring({name_col}, 8, 2) as int)").alias("month"),
        kind.alias("type"),
    ).where(F.col("type").isNotNull())
    w = Window.partitionBy("year", "month", "type").orderBy("name")
    numbered = typed.withColumn("_k", F.row_number().over(w))
    labels = [label for _, label in MANIFEST_TYPES]
    return numbered.groupBy("year", "month", "_k").pivot("type", labels).agg(F.first("name")).drop("_k")
