"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots. Bytes are aggregated per slot, and a versioned map from slots to
shards is edited until the shards' bytes are near equal: only edited slots move. The map is a table that later
runs read and edit. The hash is of the text, so equal texts share a slot. A text whose copies alone weigh over half
a shard is dealt out by id, as no map could balance it; the rest of its slot stays whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

SLOTS = 4096
#: Parts of a slot, by id, in which positions are counted; and parts of a hot text, each with a place in the map.
PARTS, HOT_PARTS = 16, 512
#: A text whose copies weigh more than this of a shard's fair bytes is dealt out; there are at most shards / HOT_SHARE such texts.
HOT_SHARE = 0.5
#: Shards count as balanced when the largest and smallest differ by less of the mean.
TOLERANCE = 0.001
WHOLE = -1

Key = tuple[int, int]


@dataclass(frozen=True)
class SlotMap:
    """One version of the map. Keys are (slot, WHOLE), and (hash of a hot text, part)."""

    version: int
    shards: int
    shard_of: dict[Key, int]
    hot: frozenset[int] = field(default_factory=frozenset)

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, {(s, WHOLE): s % shards for s in range(slots)})

    def dealt(self, text_hash: int, parts: int = HOT_PARTS, slots: int = SLOTS) -> SlotMap:
        """The parts of a hot text get places of their own, first where its slot is."""
        if text_hash in self.hot:
            return self
        home = self.shard_of[text_hash % slots, WHOLE]
        return replace(self, version=self.version + 1, hot=self.hot | {text_hash}, shard_of=self.shard_of | {(text_hash, p): home for p in range(parts)})

    def rebalanced(self, size: dict[Key, int], tolerance: float = TOLERANCE) -> SlotMap:
        """Moves slots, or swaps two, from the fullest to the emptiest shard while that narrows the gap."""
        keys = list(self.shard_of)
        bytes_ = np.array([size.get(k, 0) for k in keys], np.int64)
        shard = np.array([self.shard_of[k] for k in keys], np.int64)
        load = np.bincount(shard, weights=bytes_, minlength=self.shards).astype(np.int64)
        for _ in range(20 * len(keys)):
            high, low = int(load.argmax()), int(load.argmin())
            gap = int(load[high] - load[low])
            if gap <= tolerance * load.mean():
                break
            own, other = np.flatnonzero((shard == high) & (bytes_ > 0)), np.flatnonzero(shard == low)
            sizes, theirs = bytes_[own], np.r_[0, bytes_[other]]
            order = np.argsort(theirs, kind="stable")
            # For each slot of the fullest shard, the partner (or none) that brings the exchange closest to half the gap.
            at = np.searchsorted(theirs[order], sizes - gap / 2).clip(1, len(order)) if len(order) > 1 else np.ones(len(sizes), np.int64)
            best = None
            for near in (at - 1, at.clip(0, len(order) - 1)):
                moved = sizes - theirs[order][near]
                off = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), np.iinfo(np.int64).max)
                k = int(off.argmin())
                if off[k] < np.iinfo(np.int64).max and (best is None or off[k] < best[0]):
                    best = (off[k], int(own[k]), int(order[near[k]]), int(moved[k]))
            if best is None:
                break
            _, a, partner, moved = best
            shard[a] = low
            if partner:
                shard[other[partner - 1]] = high
            load[high] -= moved
            load[low] += moved
        return replace(self, version=self.version + 1, shard_of={k: int(s) for k, s in zip(keys, shard, strict=True)})

    def grown(self, size: dict[Key, int]) -> SlotMap:
        """One shard more; slots move into it alone, from the fullest shards, until it has its fair bytes."""
        new, at = self.shards, dict(self.shard_of)
        load = np.zeros(new + 1, np.int64)
        for k, s in at.items():
            load[s] += size.get(k, 0)
        fair = load.sum() / (new + 1)
        for k in sorted(at, key=lambda k: (-size.get(k, 0), k)):
            n = size.get(k, 0)
            if n and load[at[k]] - n >= fair * (1 - TOLERANCE) - n / 2 and load[new] + n <= fair and load[at[k]] > fair:
                load[at[k]] -= n
                load[new] += n
                at[k] = new
        return SlotMap(self.version + 1, new + 1, at, self.hot)

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, shards, slot, text_hash, part, shard); text_hash and part are null for whole slots. At most SLOTS + shards / HOT_SHARE * HOT_PARTS rows."""
        rows = [(self.version, self.shards, s, None, None, x) if p == WHOLE else (self.version, self.shards, s % SLOTS, s, p, x) for (s, p), x in self.shard_of.items()]
        return spark.createDataFrame(rows, "version int, shards int, slot int, text_hash long, part int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the table at ``path``."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def read(table: DataFrame, version: int | None = None) -> SlotMap:
        """The newest version of a table that ``save`` wrote, or the one that is asked for."""
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.filter(F.col("version") == version).select("shards", "slot", "text_hash", "part", "shard").collect()
        if not rows:
            raise ValueError("no such version of the map")
        at = {(slot, WHOLE) if h is None else (h, part): shard for _, slot, h, part, shard in rows}
        return SlotMap(version, rows[0][0], at, frozenset(h for _, _, h, _, _ in rows if h is not None))


def sizes_of(docs: DataFrame, plan: SlotMap, id_col: str = "doc_id", text_col: str = "text") -> dict[Key, int]:
    """Bytes of each key of a map, for ``rebalanced`` and ``grown`` when documents have changed."""
    return _sizes(_keyed(docs, id_col, text_col), plan)


def slot_of(text_hash: Column, slots: int = SLOTS) -> Column:
    return F.pmod(text_hash, F.lit(slots)).cast("int")


def part_of(id_: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), id_), F.lit(parts)).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hash, slot and size of each row; the size is the text's UTF-8 bytes plus 1."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("text_hash"))
    return rows.withColumn("slot", slot_of(F.col("text_hash")))


def _split(rows: DataFrame, hot: frozenset[int], id_col: str = "id") -> DataFrame:
    """``rows`` (text_hash) with hot (the hash of a hot text, else null) and hot_part."""
    own = F.when(F.col("text_hash").isin(list(hot)), F.col("text_hash")) if hot else F.lit(None).cast("long")
    return rows.withColumn("hot", own).withColumn("hot_part", F.when(F.col("hot").isNotNull(), part_of(F.col(id_col), HOT_PARTS)))


def _sizes(keyed: DataFrame, plan: SlotMap) -> dict[Key, int]:
    sums = _split(keyed, plan.hot).groupBy(F.coalesce("hot", F.col("slot").cast("long")), F.coalesce("hot_part", F.lit(WHOLE))).agg(F.sum("size"))
    return {(r[0], r[1]): r[2] for r in sums.collect()}  # no more than the map has keys


def plan_slots(keyed: DataFrame, shards: int) -> SlotMap:
    """The balanced map for rows (slot, text_hash, size), none of them null; repeated rows count as often as they come, no rows leave all slots where they begin.

    Only sums of slots, of hot texts and of their parts reach the driver.
    """
    plan = SlotMap.initial(shards)
    size = _sizes(keyed, plan)
    most = HOT_SHARE * sum(size.values()) / shards
    heavy = [s for (s, _), n in size.items() if n > most]
    if heavy:
        hot = keyed.filter(F.col("slot").isin(heavy)).groupBy("text_hash").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("copies")).filter((F.col("n") > most) & (F.col("copies") > 1))
        for h in sorted(r[0] for r in hot.select("text_hash").collect()):
            plan = plan.dealt(h)
        size = _sizes(keyed, plan) if plan.hot else size
    return plan.rebalanced(size)


def _located(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (slot, hot, hot_part) with their shard; the map is of bounded size."""
    whole = F.broadcast(plan.filter("text_hash is null").select("slot", F.col("shard").alias("whole_shard")))
    hot = F.broadcast(plan.filter("text_hash is not null").select(F.col("text_hash").alias("hot"), F.col("part").alias("hot_part"), F.col("shard").alias("hot_shard")))
    found = rows.join(whole, "slot", "left").join(hot, ["hot", "hot_part"], "left")
    return found.withColumn("shard", F.coalesce("hot_shard", "whole_shard")).drop("whole_shard", "hot_shard")


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", plan: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """``docs`` with a column shard (int, 0 to ``shards`` - 1) in place of any of that name, and the map used.

    Shards' bytes are near equal. A null text counts as empty; null ids and repeated rows are placed like any
    other. An empty table stays empty. Pass the map of an earlier run as ``plan`` to keep its places.
    """
    spark = docs.sparkSession
    plan = plan or plan_slots(_keyed(docs, id_col, text_col), shards)
    table = materialise(plan.table(spark), "slots")
    names = docs.drop("shard").columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    rows = _split(rows.withColumn("slot", slot_of(F.col("text_hash"))), plan.hot)
    return _located(rows, table).select(*[F.col("row").getField(c).alias(c) for c in names], "shard"), plan


def shard_positions(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    law is "bytes": shards' sizes are near equal. slot is the row's place in its shard, gapless from 0, by
    virtual slot, part and id. Places come from counts per (virtual slot, part), so that no task orders a
    whole shard. grown_shard is null under this law. See ``shard_rows`` for nulls, repeated and no rows.
    """
    plan = plan_slots(_keyed(docs, id_col, text_col), shards)
    table = materialise(plan.table(docs.sparkSession), "slots")
    rows = _located(_split(_keyed(docs, id_col, text_col), plan.hot), table).withColumn("part", F.coalesce("hot_part", part_of(F.col("id"), PARTS)))
    rows = materialise(rows.select("id", "size", "crc", "slot", "part", "shard"), "keyed")
    counts = rows.groupBy("shard", "slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "slot", "part", (F.expr("sum(n) over (partition by shard order by slot, part)") - F.col("n")).alias("start"))
    before = materialise(before, "starts")  # at most SLOTS * PARTS rows, and HOT_PARTS of a hot text
    place = F.expr("row_number() over (partition by shard, slot, part order by id, crc, size)") - 1
    out = rows.withColumn("place", place).join(F.broadcast(before), ["shard", "slot", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))
