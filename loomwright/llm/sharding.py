"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard depends on the key and the number of shards alone; one more shard takes rows only into itself, in the
necessary proportion, and no ring table is kept.

Slots are numbered without gaps in each shard by two levels: rows are dealt to hashed chunks of bounded size, chunk
offsets are running sums of chunk counts, and rows are numbered inside their chunk. No shard is one group in a task.

Defined cases: a null key hashes as a string of its own; a null text is empty and has checksum 0; rows with the same
key get different slots in the same shard; an empty table gives an empty result; an input column that is named as a
result column is replaced, all others stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import free_name, table

#: The multiplier of the 64-bit linear congruential generator that defines the method, and the generator's range.
MULTIPLIER = 2862933555777941757
RANGE = 2**64
CHUNK_ROWS = 100_000


def _digest(key: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("k:"), key.cast("string")), F.lit("null")))


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text, as a decimal."""
    return F.conv(F.substring(_digest(key), 1, 15), 16, 10).cast("decimal(20,0)")


def jump_shard(hashed: Column, n_shards: int) -> Column:
    """The jump-consistent shard of an integer from 0 to 2**64 - 1: a number from 0 to n_shards - 1.

    Each jump leads to a larger number, so n_shards steps are enough; a key that has jumped out of range keeps its
    state. Products stay below 10**38, so decimals hold them exactly where longs would overflow.
    """
    start = F.struct(hashed.cast("decimal(20,0)").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(RANGE)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k / F.lit(2**33).cast("decimal(20,0)")).cast("double")
        landed = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(2**31)) / (high + F.lit(1.0)))).cast("long")
        return F.when(s["j"] < n_shards, F.struct(k.alias("k"), s["j"].alias("b"), landed.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, jump)["b"].cast("int")


def assign_shards(docs: DataFrame, key: str, n_shards: int, order: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """``docs`` with shard, slot (from 0, without gaps in each shard) and grown_shard (with one shard more).

    Rows of a shard are in the order of a hash of the key, then the key, then ``order``. With ``apart`` the hash is of
    the key and the row's number among the rows of that key, so that copies of a row don't stand together.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    chunk, place, nth, row, offset = (free_name(docs, x) for x in ("chunk", "place", "nth", "row", "offset"))
    rows = docs.select(*kept)
    chunks = max(1, math.ceil(docs.count() / (n_shards * CHUNK_ROWS)))
    digest = _digest(F.col(key))
    if apart:
        rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*(order or (key,)))))
        digest = F.md5(F.concat_ws(":", digest, F.col(nth).cast("string")))
    places = F.conv(F.substring(digest, 16, 12), 16, 10).cast("long")
    rows = rows.withColumns({"shard": jump_shard(key_hash(F.col(key)), n_shards), "grown_shard": jump_shard(key_hash(F.col(key)), n_shards + 1), place: places})
    rows = rows.withColumn(chunk, F.floor(F.col(place) / F.lit(2.0**48) * chunks).cast("int"))
    running = Window.partitionBy("shard").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", chunk).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", chunk, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(offset))
    inside = Window.partitionBy("shard", chunk).orderBy(place, key, *order)
    numbered = rows.withColumn(row, F.row_number().over(inside).cast("long"))
    placed = numbered.join(offsets, ["shard", chunk]).withColumn("slot", F.col(row) - 1 + F.col(offset))
    return placed.select(*kept, "shard", "slot", "grown_shard")


N_SHARDS = 24


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(rows, "doc_id", N_SHARDS, ("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_entries() -> str:
    """The 256 steps of CRC-32 for a byte, from the polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        out.append(str(b))
    return ", ".join(out)


#: DuckDB has no CRC-32, so a macro-free reduction over the text's bytes takes its place; the jump is a recursive query.
OP7_SQL = f"""
WITH RECURSIVE t AS (SELECT [{_crc_entries()}]::BIGINT[] AS tbl),
d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce('k:' || CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
c AS (SELECT doc_id, digest, octet_length(encode(text)) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
      lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT *, hex(encode(text)) AS h FROM d), t),
jump AS (
  SELECT doc_id, n, CAST('0x' || substr(digest, 1, 15) AS BIGINT)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d, (VALUES ({N_SHARDS}), ({N_SHARDS + 1})) AS v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592 AS DOUBLE) + 1.0::DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (n = {N_SHARDS}) AS shard, max(b) FILTER (n = {N_SHARDS + 1}) AS grown_shard FROM jump GROUP BY doc_id)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(digest, 16, 12) AS BIGINT), c.doc_id, size, text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.doc_id
"""
