"""Operator 4: resharding by minimum-cost flow.

A layout keeps a shard's documents in blocks, a file each. From the old shards'
sizes and the new shards' capacities a minimum-cost flow (staying costs nothing,
moving costs its bytes) says how many bytes go from each shard to each other.
A shard's blocks in order are cut at those amounts: blocks that stay keep
their files, blocks that move or are cut are rewritten.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block, and the fewest blocks of a shard.
BLOCK_BYTES, LEAST_BLOCKS = 64 << 20, 8
#: Blocks up to which tables with a row a block are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


class Resharded(NamedTuple):
    flow: list[tuple[int, int, int]]  # (old shard, new shard, bytes)
    moved_bytes: int
    shards: DataFrame  # all rows of the new layout, with ``shard`` and ``slot``


def min_cost_flow(sizes: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> list[tuple[int, int, int]]:
    """Cheapest ``(i, j, amount)`` that send every old shard's size within the new capacities.

    Augments along shortest paths of the residual network. Its nodes are
    shards, not documents. Raises ``ValueError`` if the capacities are too small.
    """
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    ends: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, left, price = [], [], []

    def arc(a: int, b: int, amount: int, each: int) -> None:
        for x, y, c, p in ((a, b, amount, each), (b, a, 0, -each)):
            ends[x].append(len(to))
            to.append(y)
            left.append(c)
            price.append(p)

    for i, s in enumerate(sizes):
        arc(source, i, s, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, sizes[i], cost(i, j))
    for j, c in enumerate(capacities):
        arc(n + j, sink, c, 0)
    sent = 0
    while sent < sum(sizes):
        far = [float("inf")] * (n + m + 2)
        by = [-1] * (n + m + 2)
        far[source], queue, waiting = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in ends[a]:
                if left[e] > 0 and far[a] + price[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[a] + price[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if by[sink] < 0:
            raise ValueError("the new shards cannot hold the old ones")
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
        sent += amount
    first = 2 * n
    return [(i, j, left[first + 2 * (i * m + j) + 1]) for i in range(n) for j in range(m) if left[first + 2 * (i * m + j) + 1] > 0]


def schema_of(docs: DataFrame) -> T.StructType:
    """The columns that a layout of ``docs`` has."""
    own = ("shard", "block", "size", "position", "offset")
    kept = [f for f in docs.schema.fields if f.name.lower() not in own]
    return T.StructType([*kept, T.StructField("size", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("offset", T.LongType()),
                         T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType())])


def write_layout(docs: DataFrame, path: str, shards: int, block_bytes: int = BLOCK_BYTES, doc: str = "doc_id", text: str = "text") -> T.StructType:
    """Write ``docs`` as ``shards`` hash shards of blocks, each block a file with its rows in order; returns the layout's schema.

    The id and the text decide a row's shard and block. Added columns: ``size``
    (UTF-8 bytes of the text, null: none, plus 16), ``position`` (row of the
    block) and ``offset`` (bytes before it). Columns of these names, ``shard``
    and ``block`` are replaced. An empty table writes no block; its layout is
    read by the schema. Rows with null ids or texts and repeated rows are rows
    like others.
    """
    schema = schema_of(docs)
    docs = docs.drop("shard", "block", "size", "position", "offset")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    total = docs.select(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(LEAST_BLOCKS, -(-total // (shards * block_bytes)))
    h = F.xxhash64(doc, text)
    order = Window.partitionBy("shard", "block").orderBy(F.col("size").desc(), doc, F.xxhash64(text))
    (docs.withColumn("size", size).withColumn("shard", F.pmod(h, F.lit(shards)).cast("int"))
     .withColumn("block", F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks)).cast("int"))
     .withColumn("position", F.row_number().over(order) - 1)
     .withColumn("offset", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
     .write.partitionBy("shard", "block").option("compression", "zstd").parquet(path))
    return schema


def reshard(spark: SparkSession, path: str, moved_path: str, new: int, schema: T.StructType | None = None) -> Resharded:
    """Reshard the layout at ``path`` to ``new`` shards of near equal bytes, rewriting affected blocks to ``moved_path``.

    A document goes where its middle byte falls, so a shard's size is off by at
    most half of the document at each of its few cuts. Slots count a shard's rows
    from 0 without gaps, by old shard, block and position. ``schema`` is what
    :func:`write_layout` returned; with it an empty layout stays empty. Columns
    of the documents may have any names but those of the layout; ``slot`` is
    replaced.
    """
    layout = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    payload = [c for c in layout.columns if c.lower() not in ("shard", "block", "size", "position", "offset", "slot")]
    # the documents' columns travel as one, so that no name of theirs meets one of ours
    light = layout.select("shard", "block", "size", "position", "offset")
    layout = layout.select(F.struct(*[f"`{c}`" for c in payload]).alias("row"), *light.columns)
    blocks = light.groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
    per_shard = blocks.groupBy("shard").agg(F.sum("bytes"), F.count("*")).collect()  # a row a shard
    out = ["row.*", "size", "shard", "slot"]
    if not per_shard:
        return Resharded([], 0, layout.select("row", "size", "shard", F.lit(0).cast("long").alias("slot")).select(*out))
    held = {r[0]: r[1] for r in per_shard}
    few = (lambda df: F.broadcast(df)) if sum(r[2] for r in per_shard) <= BROADCAST_BLOCKS else (lambda df: df)
    old = max(held, default=-1) + 1
    total = sum(held.values())
    sizes = [held.get(i, 0) for i in range(old)]
    flow = min_cost_flow(sizes, [total // new + (j < total % new) for j in range(new)])
    cuts, at = [], dict.fromkeys(range(old), 0)
    for i, j, n in sorted(flow, key=lambda x: (x[0], x[0] != x[1], x[1])):  # what stays comes first
        cuts.append((i, j, at[i], at[i] + n))
        at[i] += n
    # a row for each pair of shards with a transfer: at most old + new of them
    cuts = F.broadcast(spark.createDataFrame(cuts, "shard int, to int, lower long, upper long"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    within = placed.join(cuts, "shard").where("start >= lower AND start + bytes <= upper AND to = shard")
    stay = within.select("shard", "block", F.lit(True).alias("stays"))
    placed = placed.join(stay, ["shard", "block"], "left").select("shard", "block", "start", F.coalesce("stays", F.lit(False)).alias("stays"))
    rows = layout.join(few(placed), ["shard", "block"])
    gone = rows.where("NOT stays").withColumn("middle", F.expr("start + offset + size div 2"))
    gone = gone.join(cuts, "shard").where("middle >= lower AND middle < upper")
    given = ["row", "size"]
    order = Window.partitionBy("to", "shard", "block").orderBy("position")
    (gone.select(*given, "to", "shard", "block", (F.row_number().over(order) - 1).alias("position"))
     .withColumnRenamed("shard", "from_shard").withColumnRenamed("to", "shard").withColumnRenamed("block", "from_block")
     .write.partitionBy("shard").option("compression", "zstd").parquet(moved_path))
    kept = rows.where("stays").select(*given, "shard", F.col("shard").alias("from_shard"), F.col("block").alias("from_block"), "position")
    # nothing may have moved, and then no file tells the columns
    moved = spark.read.schema(kept.schema).parquet(moved_path)
    after = kept.unionByName(moved.select(*kept.columns))
    # slots: the rows of each piece of a shard, added up in order; pieces are as many as blocks
    counted = after.groupBy("shard", "from_shard", "from_block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("from_shard", "from_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("shard", "from_shard", "from_block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    after = after.join(few(base), ["shard", "from_shard", "from_block"]).withColumn("slot", (F.col("base") + F.col("position")).cast("long"))
    return Resharded(flow, sum(n for i, j, n in flow if i != j), after.select(*out))

