"""Shards of near equal size out of groups that must stay whole (native: DataFrame functions only).

Groups lie in the order of their hash. The smallest capacity with which a greedy cut needs no more than the wanted number
of shards is found by binary search. The search needs sums of many groups only: the driver holds the sums of hash cells (a
fixed number of them), and asks for finer cells just where a cut may still fall, until every cut is known to the group.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.shared import keep, literal_table, running_total

CELLS_AT_ONCE = 1 << 16
"""Cells that one round of the search brings to the driver, about."""


@dataclass
class Cells:
    """Sums of consecutive runs of groups: first hash, hash bits that name the cell, size, number of groups."""

    rows: list[tuple[int, int, int, int]]

    def __post_init__(self):
        self.rows.sort()
        self.edges = [0]
        for _, _, size, _ in self.rows:
            self.edges.append(self.edges[-1] + size)

    @property
    def total(self) -> int:
        return self.edges[-1]

    def known(self, at: int) -> int:
        """The last cell edge at or before a position."""
        return self.edges[bisect_right(self.edges, at) - 1]

    def possible(self, at: int) -> int:
        """The last position at or before one where groups may meet: inside a cell of many groups, anywhere."""
        i = bisect_right(self.edges, at) - 1
        return at if i < len(self.rows) and self.rows[i][3] > 1 else self.edges[i]

    def cuts(self, capacity: int, shards: int, step) -> list[int]:
        """Ends of the shards of a greedy cut; it is a success if the last one is the total."""
        ends, at = [], 0
        for _ in range(shards):
            at = step(at + capacity) if at + capacity < self.total else self.total
            ends.append(at)
        return ends

    def smallest(self, shards: int, step) -> int:
        """The smallest capacity whose greedy cut reaches the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, step)[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, shards: int) -> list[tuple[int, int, int, int]]:
        """Cells in which a cut of the best capacity may fall and whose groups are not yet known."""
        low, high = self.smallest(shards, self.possible), self.smallest(shards, self.known)
        found: dict[int, tuple[int, int, int, int]] = {}
        for first, last in zip(self.cuts(low, shards, self.known), self.cuts(high, shards, self.possible), strict=True):
            a, b = bisect_right(self.edges, first) - 1, bisect_right(self.edges, last) - 1
            for i in range(a, min(b + 1, len(self.rows))):
                if self.rows[i][3] > 1 and self.edges[i] < self.total and not (first == last == self.edges[i]):
                    found[i] = self.rows[i]
        return list(found.values())


def cells_of(groups: DataFrame, bits: int) -> DataFrame:
    """Sums of the groups whose hashes agree in the upper ``bits``."""
    cell = F.shiftright("group_hash", 64 - bits) if bits < 64 else F.col("group_hash")
    return (groups.groupBy(cell.alias("cell"))
            .agg(F.sum("group_size").alias("size"), F.count("*").alias("groups")))


def capacity_cuts(groups: DataFrame, shards: int, at_once: int = CELLS_AT_ONCE) -> list[int]:
    """First hashes of shards 1, 2, ... of the greedy cut at the smallest capacity; fewer if fewer shards are needed.

    ``groups``: one row for each group, with its ``group_hash`` (distinct) and ``group_size``.
    """
    bits = max(1, at_once.bit_length() - 1)
    cells = Cells([(r.cell << 64 - bits, bits, r.size, r.groups) for r in cells_of(groups, bits).collect()])
    while doubtful := cells.doubtful(shards):
        # All doubtful cells of the coarsest kind, split so that about `at_once` finer ones come back.
        bits = min(c[1] for c in doubtful)
        split = [c for c in doubtful if c[1] == bits]
        finer = min(64, bits + max(1, (at_once // len(split)).bit_length() - 1))
        wanted = literal_table(groups.sparkSession, [(c[0] >> 64 - bits,) for c in split], "parent long")
        # The list holds no more cells than two rounds can bring, so it may be sent to every task.
        inside = groups.join(F.broadcast(wanted), F.shiftright("group_hash", 64 - bits) == F.col("parent"), "left_semi")
        gone = set(split)
        cells = Cells([c for c in cells.rows if c not in gone]
                      + [(r.cell << 64 - finer, finer, r.size, r.groups) for r in cells_of(inside, finer).collect()])
    ends = cells.cuts(cells.smallest(shards, cells.known), shards, cells.known)
    starts = [cells.rows[bisect_right(cells.edges, e) - 1][0] for e in ends if e < cells.total]
    return list(dict.fromkeys(starts))


def minimax_shards(rows: DataFrame, size: str, group_hash: str, shards: int, first: str = "shard",
                   at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """Add the column ``first``: the shard, 0 to ``shards`` - 1, of each row's group.

    Rows with one ``group_hash`` stay together. A group above a fair share of what is left (total over shards) gets a
    shard of its own, largest first: no cut can make that shard smaller, and the others then share the rest evenly. The
    rest is cut in the order of its hashes at the smallest possible capacity. Without rows there is nothing to cut; with
    fewer groups than shards the last shards stay empty.
    """
    groups = keep(rows.groupBy(F.col(group_hash).alias("group_hash"))
                  .agg(F.sum(size).cast("long").alias("group_size")))
    left = groups.agg(F.sum("group_size")).first()[0] or 0
    large: list[int] = []
    # No more than `shards` groups can be above a fair share.
    for g in groups.orderBy(F.desc("group_size"), "group_hash").limit(shards).collect():
        if len(large) + 1 >= shards or g.group_size * (shards - len(large)) <= left:
            break
        large.append(g.group_hash)
        left -= g.group_size
    rest = groups.filter(~F.col("group_hash").isin(large)) if large else groups
    starts = capacity_cuts(rest, shards - len(large), at_once)
    shard = F.lit(len(large))
    for start in starts:
        shard = shard + (F.col(group_hash) >= F.lit(start).cast("long")).cast("int")
    for i, h in enumerate(large):
        shard = F.when(F.col(group_hash) == F.lit(h).cast("long"), F.lit(i)).otherwise(shard)
    return rows.withColumn(first, shard)


def shard_documents(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Shards of near equal bytes, equal texts together, with each document's place in its shard.

    Size: UTF-8 bytes of the text plus ``overhead``. A null text has no bytes; it lies with the empty texts, and its
    checksum is theirs, 0. Rows that repeat are rows of their own with a slot each; a null doc_id is a value like others.
    A very long text counts with all its bytes; an empty table gives no rows. Other columns of the input are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(documents.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group_hash")))
    placed = minimax_shards(rows, "size", "group_hash", shards)
    placed = placed.withColumn("spread", F.xxhash64("doc_id", "group_hash"))
    slots = running_total(placed, ["shard"], ["doc_id", "group_hash"], F.lit(1), "slot", "spread")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
