"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a skip from its name's hash). Shards
take turns; at its turn a shard claims the first free slot in its order. A document's slot is its hash modulo the table's
size, so placement is one lookup, shards are even to within a slot, and a change of shards moves few documents.

DataFrame functions only. The table has ``slots`` rows whatever the input's size (checked), so it is broadcast.

Results in the odd cases: a null key is placed as the empty string; repeated keys share a shard; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.columns import free_names

SLOTS = 8191
SHARDS = 64
MOST_SLOTS = 1 << 17


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hash_mod(key: Column, m: int) -> Column:
    """The first 15 hex digits of the key's MD5, modulo m."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(m))


def lookup_table(shards: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for a DataFrame of distinct shard names in column ``shard``.

    One fold over the turns fills the table. State: the slots as two bytes each (FFFF free), how far each shard has read its
    order, whose turn it is, and how many slots are taken. A step is one look at one slot; a shard looks at a slot once, so
    shards x slots steps always suffice, and steps after the last claim do nothing.
    """
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError("slots must be a prime below 131072")
    order = shards.filter(F.col("shard").isNotNull()).select("shard").distinct().agg(F.array_sort(F.collect_list("shard")).alias("names"))
    prefs = order.select(
        "names",
        F.transform("names", lambda n: hash_mod(F.concat(n, F.lit("#offset")), slots)).alias("offset"),
        F.transform("names", lambda n: hash_mod(F.concat(n, F.lit("#skip")), slots - 1) + 1).alias("skip"),
    )
    # Everything a step needs is part of the state, so that no step evaluates the columns above again.
    start = F.struct(
        F.unhex(F.repeat(F.lit("FFFF"), slots)).alias("table"),
        F.transform("names", lambda _: F.lit(0).cast("long")).alias("read"),
        F.lit(0).alias("turn"),
        F.lit(0).alias("taken"),
        F.col("offset"),
        F.col("skip"),
    )

    def look(s: Column) -> Column:
        turn = s["turn"]
        place = F.pmod(F.get(s["offset"], turn) + F.get(s["read"], turn) * F.get(s["skip"], turn), F.lit(slots)).cast("int")
        free = F.substring(s["table"], place * 2 + 1, F.lit(2)) == F.unhex(F.lit("FFFF"))
        mine = F.unhex(F.lpad(F.hex(turn), 4, "0"))
        return F.struct(
            F.when(free, F.overlay(s["table"], mine, place * 2 + 1, F.lit(2))).otherwise(s["table"]).alias("table"),
            F.transform(s["read"], lambda r, i: F.when(i == turn, r + 1).otherwise(r)).alias("read"),
            F.when(free, F.pmod(turn + 1, F.size(s["offset"]))).otherwise(turn).alias("turn"),
            (s["taken"] + free.cast("int")).alias("taken"),
            s["offset"].alias("offset"),
            s["skip"].alias("skip"),
        )

    # Rounds of ``slots`` looks, as many as shards at most: a full table passes through each round unchanged.
    one_round = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(slots)), s, lambda a, _: F.when(a["taken"] >= slots, a).otherwise(look(a)))
    full = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("names"), F.lit(1))), start, lambda a, _: F.when(a["taken"] >= slots, a).otherwise(one_round(a)))
    filled = prefs.filter(F.size("names") > 0).select("names", full["table"].alias("table"))
    cells = filled.select("names", "table", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    owner = F.conv(F.hex(F.substring(F.col("table"), F.col("slot") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    return cells.select(F.col("slot").cast("long").alias("slot"), F.get("names", owner).alias("shard"))


def shard_names(spark: SparkSession, n: int = SHARDS) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("shard-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("shard"))


def place(docs: DataFrame, table: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """key, slot and shard of every row; no shuffle of the documents."""
    keyed = docs.select(key, hash_mod(F.coalesce(F.col(key).cast("string"), F.lit("")), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def write_shards(docs: DataFrame, table: DataFrame, path: str, key: str = "doc_id", slots: int = SLOTS) -> None:
    """Whole rows, a directory per shard: ``shard_dir=``, with underscores added where the rows have such a column."""
    at, shard = free_names(docs, "slot_of_row", "shard_dir")
    slot = hash_mod(F.coalesce(F.col(key).cast("string"), F.lit("")), slots)
    names = table.select(F.col("slot").alias(at), F.col("shard").alias(shard))
    docs.withColumn(at, slot).join(F.broadcast(names), at).drop(at).write.partitionBy(shard).parquet(path)
