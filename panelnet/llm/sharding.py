"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts together.

Groups of equal texts are gathered into a bounded number of bins by a hash of the text; a group heavy enough to
unbalance a bin is an item of its own, and one of more bytes than a shard's share is split evenly. The items, whose
number depends on the number of shards and not on the data, are packed in descending order, each onto the shard where the dot product of its
sizes with the residual capacity is highest among those that it fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelnet.llm.storage import saved
from panelnet.llm.textkernel import buffers, releasing, words

BINS_PER_SHARD = 256


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: rows of ``sizes`` are items, columns dimensions, in any units."""
    total = sizes.sum(axis=0)
    item = sizes / np.where(total > 0, total, 1)
    residual = np.full((shards, sizes.shape[1]), 1 / shards)
    out = np.zeros(len(item), int)
    for i in np.argsort(-item.max(axis=1, initial=0), kind="stable"):
        fits = (residual - item[i] >= -1e-12).all(axis=1)
        score = residual @ item[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        else:  # fits nowhere: where it leaves the least excess
            score = np.minimum(residual - item[i], 0).sum(axis=1) + 1e-6 * score
        out[i] = int(np.argmax(score))
        residual[out[i]] -= item[i]
    return out


@releasing
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's number of words, an estimate of its tokens that costs one pass."""
    for batch in batches:
        counts = []
        step = 256
        for lo in range(0, batch.num_rows, step):
            data, offs = buffers(batch.column(1).slice(lo, step))
            counts.append(words(data, offs).count if len(data) else np.zeros(len(offs) - 1, int))
        n = np.concatenate(counts) if counts else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *(batch.column(i) for i in range(2, batch.num_columns))], ["doc_id", "tokens", *batch.schema.names[2:]])


def shards(docs: DataFrame, n_shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot) for every row: size is the text's UTF-8 bytes plus ``overhead``.

    Shards have near equal bytes, tokens and rows. Rows of equal texts share a shard unless they have more bytes than
    a shard's equal part; such a group is split by id into even parts. Slots number a shard's rows from 0 without
    gaps, by item and then id. Null texts count as empty ones; null ids, repeated rows and empty tables are
    allowed; other columns are ignored. Only the totals of at most ``n_shards * (2 * BINS_PER_SHARD + 1)`` items reach the driver.
    """
    spark, bins = docs.sparkSession, n_shards * BINS_PER_SHARD
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("group"))
    rows = saved(rows.mapInArrow(_measure, "doc_id long, tokens long, size long, text_crc32 long, group long").withColumn("bin", F.pmod(F.xxhash64("group", F.lit(3)), F.lit(bins)).cast("int")))

    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    heavy_at = {c: max(1.0, total[c] / bins) for c in ("bytes", "tokens", "rows")}
    over = " or ".join(f"{c} > {2 * v!r}" for c, v in heavy_at.items())
    full = rows.groupBy("bin").agg(*sums).filter(over).select("bin")  # at most 3 / 2 of the bins: bounded
    heavy = rows.join(F.broadcast(full), "bin").groupBy("group", "size", "text_crc32").agg(F.first("bin").alias("bin"), *sums).filter(over)
    share = total["bytes"] / n_shards
    heavy = heavy.select("group", "size", "text_crc32", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(share / 2)) * (F.col("bytes") > share).cast("int"), F.lit(1)).cast("int").alias("parts"), F.greatest(*(F.ceil(F.col(c) / F.lit(v)) for c, v in heavy_at.items())).cast("int").alias("salts"))
    heavy = saved(heavy.withColumn("heavy", F.lit(True)))

    key = ["group", "size", "text_crc32"]
    salt = F.xxhash64("doc_id", F.lit(5))
    item = F.when(F.col("heavy"), F.concat_ws(":", "group", "text_crc32", F.pmod(salt, "parts"))).otherwise(F.col("bin").cast("string"))
    # a heavy group's rows number at least 1 / bins of a total: there are at most 3 * bins such groups, few enough to broadcast
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("item", item)
    dealt = dealt.withColumn("lane", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id", F.lit(9)), "salts")).otherwise(F.lit(0)).cast("int"))
    lanes = [(r["item"], r["lane"], r["bytes"], r["tokens"], r["rows"]) for r in dealt.groupBy("item", "lane").agg(*sums).orderBy("item", "lane").collect()]
    names = sorted({x[0] for x in lanes})
    place = {x: i for i, x in enumerate(names)}
    sizes = np.zeros((len(names), 3))
    for name, _, *own in lanes:
        sizes[place[name]] += own
    shard_of = pack(sizes, n_shards)
    begin, used = [], np.zeros(n_shards, np.int64)
    for name, lane, _, _, n in lanes:
        s = int(shard_of[place[name]])
        begin.append((name, lane, s, int(used[s])))
        used[s] += n
    at = spark.createDataFrame(begin, T.StructType([T.StructField("item", T.StringType()), T.StructField("lane", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("begin", T.LongType())]))
    within = Window.partitionBy("item", "lane").orderBy("doc_id", *key)
    placed = dealt.join(F.broadcast(at), ["item", "lane"]).withColumn("slot", F.col("begin") + F.row_number().over(within) - 1)
    return placed.select("doc_id", "size", "text_crc32", "tokens", "shard", "slot")
