"""Sharding through fixed virtual slots, with column functions only.

A row's slot is a hash of its key modulo ``slots`` (thousands); it never
changes.  Bytes are aggregated per slot and a versioned map, a small Parquet
table, says which shard holds which slot.  Rebalancing edits the map: it moves
single slots from the fullest to the emptiest shard and stores the result as
the next version; rows are never rehashed.  A later run over the same map folder
starts from its newest version: known slots stay where they are, new ones are
dealt round, sizes are renewed, more shards start empty, and the edits are
stored as one more version.

A slot that holds more than ``1 / (HOT * shards)`` of the bytes or rows (one
repeated or null key) is split into sub-slots by row number, so no shard and
no window group has to take a hot key whole.  The map has at most
``slots + 2 * HOT * shards`` rows; only this bounded table meets the driver.

Law ``bytes``: the shards' byte sums are near equal.

A split slot keeps its number of sub-slots in later versions, but its rows are
dealt to them by row number, so they may change places between runs.

Defined cases: very long texts count by their bytes alone; a null text has size 1 (no bytes plus 1) and crc 0, as an empty
one has; null keys hash like any other key; repeated rows are separate rows
with positions of their own; an empty table gives an empty table and a map in
which every shard is empty; other columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from oriel.llm.common import materialize, read_table, scratch_path

SLOTS = 4096
HOT = 16
MAP_SCHEMA = "slot int, sub int, splits int, bytes long, rows long, shard int"


def size_of(text) -> F.Column:
    """UTF-8 bytes plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def with_slot(df: DataFrame, key: str, slots: int = SLOTS, out: str = "virtual_slot") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int"))


def split_slots(sized: DataFrame, shards: int) -> DataFrame:
    """Rows (virtual_slot, splits) of the slots that are hot by bytes or rows."""
    per = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = per.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).first()
    fair_b = max(1.0, (total["b"] or 0) / (HOT * shards))
    fair_r = max(1.0, (total["r"] or 0) / (HOT * shards))
    share = F.ceil(F.greatest(F.col("bytes") / F.lit(fair_b), F.col("rows") / F.lit(fair_r))).cast("int")
    return (per.where((F.col("rows") > 1) & (share > 1))
            .select("virtual_slot", F.least(share, F.col("rows")).cast("int").alias("splits")))


def slot_sizes(placed: DataFrame) -> DataFrame:
    """Bytes and rows per (slot, sub-slot)."""
    return (placed.groupBy(F.col("virtual_slot").alias("slot"), "sub")
            .agg(F.first("splits").alias("splits"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt round."""
    return sizes.withColumn("shard", F.pmod(F.col("slot") + F.col("sub"), F.lit(shards)).cast("int"))


def store_map(slot_map: DataFrame, path: str, version: int, shards: int) -> None:
    """One more version; a row of slot -1 holds the number of shards."""
    head = slot_map.sparkSession.createDataFrame([(-1, 0, 1, 0, 0, shards)], MAP_SCHEMA)
    slot_map.select(*[c.split()[0] for c in MAP_SCHEMA.split(", ")]).unionByName(head).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").where("slot >= 0")


def newest_version(spark: SparkSession, path: str) -> int:
    """0 where no map is stored."""
    try:
        maps = spark.read.schema(f"{MAP_SCHEMA}, version int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return maps.agg(F.max("version")).first()[0] or 0


def next_map(sizes: DataFrame, stored: DataFrame, shards: int) -> DataFrame:
    """The stored map with new sizes; slots that it lacks are dealt round."""
    old = stored.select("slot", "sub", F.col("splits").alias("s"), F.col("shard").alias("held"))
    both = sizes.join(old, ["slot", "sub"], "full")
    return both.select("slot", "sub", F.coalesce("splits", "s").alias("splits"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
                       F.coalesce("rows", F.lit(0)).alias("rows"),
                       F.coalesce(F.when(F.col("held") < shards, F.col("held")), F.pmod(F.col("slot") + F.col("sub"), F.lit(shards))).cast("int").alias("shard"))


def rebalance(spark: SparkSession, slot_map: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """The edited map and the number of moves.  Moves or swaps single slots
    between the fullest and the emptiest shard while that narrows their gap.
    Works on the map alone (bounded, see above)."""
    rows = [r.asDict() for r in slot_map.collect()]
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for i, r in enumerate(rows):
        load[r["shard"]] += r["bytes"]
        insort(held[r["shard"]], (r["bytes"], i))
    moves = 0

    def move(i: int, to: int) -> None:
        r = rows[i]
        held[r["shard"]].remove((r["bytes"], i))
        insort(held[to], (r["bytes"], i))
        load[r["shard"]] -= r["bytes"]
        load[to] += r["bytes"]
        r["shard"] = to

    while shards > 1 and moves < 4 * len(rows):
        full = max(range(shards), key=lambda s: (load[s], -s))
        thin = min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[thin]
        k = bisect_right(held[full], (gap // 2, len(rows))) - 1
        if k >= 0 and held[full][k][0] * 4 >= gap:
            move(held[full][k][1], thin)
            moves += 1
            continue
        # no slot that fits well: the swap whose difference is nearest to half the gap
        best = None
        for b, i in held[full]:
            j = bisect_right(held[thin], (b - gap // 2, -1))
            for t in held[thin][max(0, j - 1):j + 1]:
                d = b - t[0]
                if 0 < d < gap and (best is None or abs(2 * d - gap) < best[0]):
                    best = (abs(2 * d - gap), i, t[1])
        if k >= 0 and held[full][k][0] and (best is None or abs(2 * held[full][k][0] - gap) <= best[0]):
            move(held[full][k][1], thin)
        elif best:
            move(best[1], thin)
            move(best[2], full)
        else:
            break
        moves += 1
    data = [tuple(r[c.split()[0]] for c in MAP_SCHEMA.split(", ")) for r in rows]
    return spark.createDataFrame(data, MAP_SCHEMA), moves


def shard(df: DataFrame, key: str, size: str, shards: int, slots: int = SLOTS,
          map_path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` (narrow: key, size and what the caller needs) with virtual_slot,
    sub, shard and slot (the row's position in its shard, gapless from 0);
    and the folder of the versioned map."""
    spark = df.sparkSession
    map_path = map_path or scratch_path(spark, "slot-map")
    sized = materialize(
        with_slot(df, key, slots).withColumn("size", F.col(size)).withColumn("row_no", F.monotonically_increasing_id()),
        "sized")
    version = newest_version(spark, map_path)
    hot = split_slots(sized, shards)
    if version:     # stored numbers of sub-slots stay
        kept = load_map(spark, map_path, version).groupBy(F.col("slot").alias("virtual_slot")).agg(F.max("splits").alias("stored"))
        hot = (hot.join(kept, "virtual_slot", "full").select("virtual_slot", F.coalesce("stored", "splits").alias("splits"))
               .where("splits > 1"))
    placed = (sized.join(F.broadcast(hot), "virtual_slot", "left")  # at most 2 * HOT * shards rows a version
              .withColumn("splits", F.coalesce("splits", F.lit(1)))
              .withColumn("sub", F.pmod(F.xxhash64("row_no"), F.col("splits")).cast("int")))
    sizes = slot_sizes(placed)
    if not version:
        version = 1
        store_map(first_map(sizes, shards), map_path, version, shards)
        base = load_map(spark, map_path, version)
    else:
        base = next_map(sizes, load_map(spark, map_path, version), shards)
    edited, _ = rebalance(spark, base, shards)
    version += 1
    store_map(edited, map_path, version, shards)
    # windows over the bounded map: where each (slot, sub) begins within its shard
    before = Window.partitionBy("shard").orderBy("slot", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = load_map(spark, map_path, version).select(
        F.col("slot").alias("virtual_slot"), "sub", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("at"))
    within = Window.partitionBy("virtual_slot", "sub").orderBy("row_no")
    return (placed.join(F.broadcast(offsets), ["virtual_slot", "sub"])  # bounded by the map
            .withColumn("slot", (F.col("at") + F.row_number().over(within) - 1).cast("long"))
            .drop("at", "row_no", "splits")), map_path


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", size_of(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    out, _ = shard(docs, "doc_id", "size", 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
