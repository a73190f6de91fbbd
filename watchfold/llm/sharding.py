"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a power of two of equal cells.  Each shard owns many cells that hold
its virtual nodes; a key in any other cell belongs to the next node clockwise.  A shard
takes no more than its bound; keys beyond it walk on clockwise to the next node whose
shard has room.  Only one count per cell reaches the driver, where the walk is done for
whole runs of keys; documents are then placed by cell and rank.  DataFrame operations only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

CELLS = 4096  # cells of the ring: the number of counts the driver sees
NODES = 64  # virtual nodes of a shard


class Run(NamedTuple):
    """Keys with ranks from ``lo`` (up to the next run's ``lo``) of a cell go to ``shard``, at slots from ``slot``."""

    cell: int
    lo: int
    shard: int
    slot: int


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows each shard may take: an even share, ``slack`` more, at most one apart."""
    room = max(total, int(total * (1 + slack)))
    return [room // shards + (s < room % shards) for s in range(shards)]


def ring_owners(spark: SparkSession, shards: int, nodes: int = NODES, cells: int = CELLS) -> list[int]:
    """For each cell the shard of its own or the next virtual node; two nodes in one cell: the lower shard has it."""
    node = spark.range(shards * nodes).select(
        F.floor(F.col("id") / nodes).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(cells)).alias("cell")
    )
    taken = dict(node.groupBy("cell").agg(F.min("shard").alias("shard")).collect())  # at most one row per cell
    for shard in sorted(set(range(shards)) - set(taken.values())):  # so small a ring that a shard lost all its nodes
        free = next(c for c in range(cells) if list(taken.values()).count(taken.get(c)) != 1)
        taken[free] = shard
    owners, last = [0] * cells, taken[min(taken)]
    for cell in range(cells - 1, -1, -1):
        last = owners[cell] = taken.get(cell, last)
    return owners


def walk(counts: dict[int, int], owners: list[int], limits: list[int]) -> list[Run]:
    """Where the keys of each cell go.

    All cells first fill their own shard, in ring order; what a full shard leaves over goes on,
    again in ring order, each run to the next cell clockwise whose shard has room.
    """
    room, fill, runs, over = list(limits), [0] * len(limits), [], []

    def put(cell, lo, n, shard):
        m = min(n, room[shard])
        if m:
            runs.append(Run(cell, lo, shard, fill[shard]))
            room[shard] -= m
            fill[shard] += m
        return m

    for cell in sorted(counts):
        done = put(cell, 0, counts[cell], owners[cell])
        if done < counts[cell]:
            over.append((cell, done, counts[cell] - done))
    for cell, lo, n in over:
        at = cell
        while n:
            at = (at + 1) % len(owners)
            m = put(cell, lo, n, owners[at])
            lo, n = lo + m, n - m
    return runs


def assign(spark: SparkSession, docs: DataFrame, shards: int, id_col: str = "doc_id", slack: float = 0.0, nodes: int = NODES, cells: int = CELLS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard).

    No shard holds more than its even share of the rows (plus ``slack``); with no slack counts
    are at most one apart.  Rows that repeat an id meet in one cell, where other columns settle
    their order (equal rows are interchangeable); rows with a null id lie on the ring by their
    other columns.  An empty table gives no rows.  Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    spread = F.xxhash64(*[F.col(c) for c in docs.columns])
    key = F.xxhash64(F.lit("key"), F.col(id_col))
    placed = docs.withColumn("__key", F.when(F.col(id_col).isNull(), spread).otherwise(key)).withColumn("__cell", F.pmod("__key", F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("__cell").count().collect()}  # at most one row per cell
    runs = walk(counts, ring_owners(spark, shards, nodes, cells), bounds(sum(counts.values()), shards, slack))
    plan = spark.createDataFrame([tuple(r) for r in runs], "cell int, lo bigint, shard int, slot bigint")
    per_cell = plan.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lo", "shard", "slot"))).alias("__runs"))
    order = Window.partitionBy("__cell").orderBy("__key", F.col(id_col), spread)
    ranked = placed.withColumn("__rank", (F.row_number().over(order) - 1).cast("bigint"))
    # The plan has at most cells + shards * cells small rows, whatever the table.
    met = ranked.join(F.broadcast(per_cell), F.col("__cell") == F.col("cell"))
    run = F.element_at(F.filter("__runs", lambda r: r["lo"] <= F.col("__rank")), -1)
    out = met.withColumn("__run", run)
    return out.select(
        *docs.columns, F.col("__run")["shard"].alias("shard"), (F.col("__run")["slot"] + F.col("__rank") - F.col("__run")["lo"]).alias("slot")
    )


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each document; texts are read once and never shuffled."""
    slim = docs.select(F.col(id_col), text_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(spark, slim, shards, id_col)
