"""Helpers shared by the operators: tables, staged copies, connected components."""

from __future__ import annotations

import ctypes
import os
import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.llm import textarrays as ta
from faretrail.session import checkpoint_dir, write_stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers that see this package's folder import it (on a cluster, ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


_states: dict[str, dict] = {}


def own_state(operator: str) -> dict:
    """What an operator's tasks keep in this worker process for one another; what another operator's tasks have kept goes."""
    if operator not in _states:
        _states.clear()
        released()
        _states[operator] = {}
    return _states[operator]


def released() -> None:
    """Give memory that a task needs no more back to the system; called at its end, since a worker outlives it."""
    ta.forget_powers()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A path not yet used in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


#: Rows for which a copy of known length gets a file, and the fewest files it gets.
FILE_ROWS, LEAST_FILES = 100_000, 16


def staged(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and go on from the copy.

    The copy cuts the lineage, is visible to every executor and survives the
    loss of any of them. With ``most_rows``, which ``df`` does not exceed, it
    has files for so many rows and not one for every shuffle partition.
    """
    if most_rows is not None:
        df = df.coalesce(max(LEAST_FILES, most_rows // FILE_ROWS))
    return df.sparkSession.read.parquet(write_stage(df))


def unstaged(df: DataFrame) -> None:
    """Delete the copy that ``staged`` wrote for ``df``; nothing that is still to be computed may read it."""
    jvm, root = df.sparkSession.sparkContext._jvm, checkpoint_dir(df.sparkSession).rstrip("/")
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() != posixpath.basename(root) or not path.getName().startswith("faretrail-stage-"):
            raise ValueError(f"not a staged copy: {folder}")
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stars(edges: DataFrame) -> bool:
    """Does every upper end ``u`` hang on one lower end ``v`` that is no upper end itself?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as edges ``(a, b)`` of longs.

    Returns ``(node, component)``, the component being its smallest node. Each
    round hangs every neighbour above a node on the node's smallest neighbour
    (large star), then every neighbour below it (small star); both are a
    map-side combined minimum and an equi-join, so a node with very many edges
    is no single task's work. Rounds are logarithmic in practice and stop when
    the edges are stars. Each round is a written copy; none has more edges than
    were given, which should come from a written copy themselves, since they are
    counted first.
    """
    most = edges.count()
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = staged(e.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most)
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), most)
        # now every edge leads down: u above v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                              .union(least.select("u", F.col("m").alias("v"))).distinct(), most)
        unstaged(before), unstaged(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
