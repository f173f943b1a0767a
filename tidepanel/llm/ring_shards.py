"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into ``cells`` arcs. Every shard has ``nodes`` virtual nodes
on it, and a cell belongs to the first node clockwise. The load of a cell is the
sum of its documents' sizes; a shard takes cells until it holds (1 + slack) of
the mean, and a cell that does not fit continues clockwise to the next shard
with room. Large cells are placed first, so small ones level the loads. Loads are
summed by the cluster; only one number per cell (a fixed count) reaches the
driver, where the ring is walked. The law kept is ``bytes``.

Documents with equal texts share a ring position and so a shard. A group of
copies that is larger than a quarter of a shard gets several positions, dealt by
doc_id, each of about a twentieth of a shard.

``slot`` numbers the rows of a shard from 0. Rows are numbered within many hash
groups at once and offset by the groups before, so no task holds a whole shard.

Defined cases: a null text has no bytes and the crc32 of none; a null doc_id is a
value like others; repeated rows each get a slot; an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are passed through by ``assign``; a
column with the name of the new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.shared import columns_of, forget, stored, whole_row

CELL_BITS = 16


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _size():
    return (F.octet_length(_text()) + 8).cast("long")


def ring_nodes(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    placed = sorted((xxhash.xxh64_intdigest(f"{s}/{v}"), s) for s in range(shards) for v in range(nodes))
    return [(p >> (64 - CELL_BITS), s) for p, s in placed]


def place_cells(loads: dict[int, int], shards: int, nodes: int = 128, slack: float = 0.002) -> dict[int, int]:
    """The shard of every cell under bounded loads."""
    ring = ring_nodes(shards, nodes)
    after, at = [0] * (1 << CELL_BITS), 0
    for cell in range(1 << CELL_BITS):
        while at < len(ring) and ring[at][0] < cell:
            at += 1
        after[cell] = at % len(ring)
    room = [(1 + slack) * sum(loads.values()) / shards] * shards
    found = {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        seen: set[int] = set()
        i = after[cell]
        while len(seen) < shards:
            s = ring[i][1]
            if room[s] >= load:
                break
            seen.add(s)
            i = (i + 1) % len(ring)
        else:  # no shard has room for it whole
            s = max(range(shards), key=lambda x: (room[x], -x))
        room[s] -= load
        found[cell] = s
    return found


@dataclass
class RingPlan:
    """Which shard every cell belongs to, and the split groups of copies."""

    shards: int
    split: dict[int, int]
    cells: dict[int, int]

    @classmethod
    def over(cls, rows: DataFrame, shards: int, nodes: int = 128, slack: float = 0.002) -> RingPlan:
        """``rows``: doc_id, size and text_hash of every document."""
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        part = max(total / shards, 1)
        # At most 4 * shards groups can be that large.
        groups = rows.groupBy("text_hash").agg(F.sum("size").alias("b")).filter(F.col("b") > part / 4)
        split = {r.text_hash: int(-(-r.b // max(part / 20, 1))) for r in groups.collect()}
        plan = cls(shards, split, {})
        loads = rows.groupBy(plan.cell().alias("cell")).agg(F.sum("size").alias("b")).collect()
        plan.cells = place_cells({r.cell: r.b for r in loads}, shards, nodes, slack)
        return plan

    def cell(self):
        """The cell of a row with doc_id and text_hash."""
        salt = F.lit(0).cast("long")
        if self.split:
            pieces = F.create_map(*[F.lit(x) for pair in self.split.items() for x in pair])[F.col("text_hash")]
            salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), pieces.cast("long")), salt)
        return F.shiftrightunsigned(F.xxhash64("text_hash", salt), 64 - CELL_BITS).cast("int")

    def table(self, spark) -> DataFrame:
        """(cell, shard): as many rows as cells hold documents, 65,536 at most."""
        return spark.createDataFrame(sorted(self.cells.items()) or [], "cell int, shard int")


def assign(docs: DataFrame, shards: int = 24, name: str = "shard", nodes: int = 128, slack: float = 0.002) -> DataFrame:
    """``docs`` with a column for the shard; texts are not shuffled."""
    rows = stored(docs.select("doc_id", _size().alias("size"), F.xxhash64(_text()).alias("text_hash")), "shard-rows")
    plan = RingPlan.over(rows, shards, nodes, slack)
    forget(rows)
    held = docs.select(whole_row(docs).alias("doc"), "doc_id", F.xxhash64(_text()).alias("text_hash"))
    held = held.withColumn("cell", plan.cell()).join(F.broadcast(plan.table(docs.sparkSession)), "cell", "left")
    return held.select(*columns_of("doc", [c for c in docs.columns if c != name]), F.col("shard").alias(name))


def sharded(docs: DataFrame, shards: int = 24, nodes: int = 128, slack: float = 0.002, group_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = docs.select("doc_id", _size().alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), F.xxhash64(_text()).alias("text_hash"))
    rows = stored(rows, "shard-rows")
    plan = RingPlan.over(rows, shards, nodes, slack)
    groups = max(4, -(-rows.count() // (shards * group_rows)))
    rows = rows.withColumn("cell", plan.cell()).join(F.broadcast(plan.table(docs.sparkSession)), "cell", "left")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups)).cast("int"))
    counts = rows.groupBy("shard", "g").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "g", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "g").orderBy("doc_id", "text_hash")
    rows = rows.withColumn("at", F.row_number().over(own)).join(F.broadcast(counts) if groups * shards <= 1_000_000 else counts, ["shard", "g"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))
