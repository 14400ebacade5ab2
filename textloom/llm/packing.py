"""Shards of fixed capacity by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Work, col

LANE = 50_000  # groups that one task packs


class Tree:
    """A treap of (room, bin): balanced in expectation, with search for the tightest room of at least some size."""

    def __init__(self):
        self.root, self.rng = None, random.Random(0)

    def add(self, key: tuple[int, int]) -> None:
        path, t, rank = [], self.root, self.rng.random()
        while t is not None and t[1] < rank:
            side = 2 if key < t[0] else 3
            path.append((t, side))
            t = t[side]
        low, high = self._split(t, key)
        node = [key, rank, low, high]
        if path:
            path[-1][0][path[-1][1]] = node
        else:
            self.root = node

    @staticmethod
    def _split(t, key):
        """Nodes under t below and above key."""
        low_root, high_root = [None, 0, None, None], [None, 0, None, None]
        low, high = (low_root, 3), (high_root, 2)
        while t is not None:
            if t[0] < key:
                low[0][low[1]] = t
                low, t = (t, 3), t[3]
            else:
                high[0][high[1]] = t
                high, t = (t, 2), t[2]
        low[0][low[1]] = high[0][high[1]] = None
        return low_root[3], high_root[2]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least (room, bin) with room >= size."""
        best, parent, side, t, above, way = None, None, 0, self.root, None, 0
        while t is not None:
            if t[0][0] >= size:
                best, parent, side = t, above, way
                above, way, t = t, 2, t[2]
            else:
                above, way, t = t, 3, t[3]
        if best is None:
            return None
        a, b = best[2], best[3]
        hole, at = parent if parent is not None else [None, 0, None, None], side if parent is not None else 2
        top = hole
        while a is not None or b is not None:
            if b is None or (a is not None and a[1] < b[1]):
                hole[at] = a
                hole, at, a = a, 3, a[3]
            else:
                hole[at] = b
                hole, at, b = b, 2, b[2]
        hole[at] = None
        if parent is None:
            self.root = top[2]
        return best[0]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes in descending order. An item over the capacity gets a bin to itself."""
    tree, out, n = Tree(), [], 0
    for size in sizes:
        found = tree.take(size) if size <= capacity else None
        room, b = found if found else (capacity, n)
        if found is None:
            n += 1
        out.append(b)
        if size < capacity and room > size:
            tree.add((room - size, b))
        elif room == size == 0:
            tree.add((0, b))
    return out


def _packer(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "unit"], ascending=[False, True], kind="stable", na_position="last")
        return rows.assign(bin=pack(rows["size"].tolist(), capacity))

    return run


GRAIN = 64  # groups under this part of the capacity are bundled when their bin is packed again


def pack_groups(groups: DataFrame, capacity: int, full: float = 0.999) -> DataFrame:
    """groups(unit long, size long) -> (unit, size, shard long), shards numbered from 0.

    Groups are spread over lanes of about LANE groups by a hash, and each lane is packed by itself, in a
    task of its own. A lane's bins are settled if they are `full` or no group fits into them. What the other
    bins hold is packed again, in fewer lanes, its small groups bundled to at least half a GRAIN-th of the
    capacity, so that an open bin comes to a few dozen pieces however many groups it has. If that is too much
    for half the lanes, only the emptier half of the bins is packed again. That goes on until one lane is
    left, or the volume of the open bins shows that none can be saved, or no fewer lanes would do.
    """
    spark = groups.sparkSession
    work = Work(spark, "packing")
    now = work.table(groups.select("unit", "size"), "groups")
    n, least = now.agg(F.count("*"), F.min("size")).first()
    settled, links = [], []
    while n:
        level, lanes = len(settled), -(-n // LANE)
        laned = now.withColumn("lane", F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(lanes)).cast("long"))
        packed = work.table(laned.repartition(lanes, "lane").groupBy("lane").applyInPandas(_packer(capacity), "unit long, size long, lane long, bin long"), "packed")
        used = packed.groupBy("lane", "bin").agg(F.sum("size").alias("used")).where((F.col("used") < full * capacity) & (F.col("used") + least <= capacity))
        bins, volume, half = used.agg(F.count("*"), F.sum("used"), F.percentile_approx("used", 0.5)).first()
        if lanes == 1 or not bins or -(-volume // capacity) >= bins:
            settled.append(packed)
            break
        small = F.col("size") * GRAIN < capacity
        upto = F.sum("size").over(Window.partitionBy("lane", "bin", small).orderBy(F.desc("size"), "unit").rowsBetween(Window.unboundedPreceding, -1))
        bundle = F.xxhash64(F.lit(level + 1), "lane", "bin", F.floor(F.coalesce(upto, F.lit(0)) * GRAIN / capacity))
        for some in (used, used.where(F.col("used") <= half)):
            some = some.select("lane", "bin")
            link = work.table(packed.join(some, ["lane", "bin"]).select("unit", "size", F.when(small, bundle).otherwise(F.col("unit")).alias("piece")), "links")
            pieces = work.table(link.groupBy(F.col("piece").alias("unit")).agg(F.sum("size").alias("size")), "pieces")
            n, least = pieces.agg(F.count("*"), F.min("size")).first()
            if -(-n // LANE) * 2 <= lanes:
                break
        if -(-n // LANE) > 0.75 * lanes:
            settled.append(packed)
            break
        settled.append(packed.join(some, ["lane", "bin"], "left_anti"))
        links.append(link)
        now = pieces
    if not settled:
        return now.select("unit", "size", F.lit(0).cast("long").alias("shard"))
    levels = [t.select("unit", F.lit(i).alias("level"), "lane", "bin") for i, t in enumerate(settled)]
    out, inside = settled[0].select("unit", "size", F.lit(0).alias("level"), "lane", "bin"), None
    for i, more in enumerate(levels[1:]):
        link = links[i].select(F.col("unit").alias("outer"), "piece")
        inside = links[0] if inside is None else inside.withColumnRenamed("piece", "outer").join(link, "outer").select("unit", "size", "piece")
        out = out.union(inside.join(more.withColumnRenamed("unit", "piece"), "piece").select("unit", "size", "level", "lane", "bin"))
    tables = [t.select("level", "lane", "bin").distinct() for t in levels]
    per = reduce(DataFrame.union, tables).groupBy("level", "lane").agg(F.max("bin").alias("m")).collect()  # a row for each lane
    base, at = [], 0
    for r in sorted(per, key=lambda r: (r.level, r.lane)):
        base.append((r.level, r.lane, at))
        at += r.m + 1
    starts = spark.createDataFrame(base, "level int, lane long, base long")
    return out.join(starts, ["level", "lane"]).select("unit", "size", (F.col("base") + F.col("bin")).alias("shard"))


def text_group(text: Column) -> Column:
    """Equal texts make one group, so that no two shards hold copies of a text. Null is the group of all null texts."""
    return F.xxhash64(text)


def assign_shards(docs: DataFrame, capacity: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """(doc_id, group_key long, bytes long, shard long): the shard of every row of docs.

    group: an expression of what must stay together, text_group by default. A group larger than capacity
    has a shard to itself, the only kind of shard over capacity. Shard numbers can have gaps.

    Nulls: a null text has 0 bytes, an empty one too; null groups are one group. A null doc_id keeps its row.
    Repeated rows are in one group. Groups of equal size go by key. An empty table gives no rows. Other
    columns aren't read.
    """
    work = Work(docs.sparkSession, "shards")
    key = group if group is not None else text_group(col(text_col).cast("string"))
    rows = work.table(docs.select(col(id_col).alias("doc_id"), F.xxhash64(key).alias("group_key"), F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes")), "rows")
    packed = pack_groups(rows.groupBy(F.col("group_key").alias("unit")).agg(F.sum("bytes").alias("size")), capacity)
    return rows.join(packed.select(F.col("unit").alias("group_key"), "shard"), "group_key").select("doc_id", "group_key", "bytes", "shard")
