"""Sharding by vector bin packing.

Groups of equal texts are items with three sizes: bytes, tokens and rows. Each
item goes to the shard whose residual capacity has the largest dot product with
the item's sizes (all in shares of the corpus), largest items first. Large groups are
items of their own; small ones are pooled by hash into a fixed number of
buckets, so the packer sees a bounded number of items at any input size. A group
larger than a shard can't be whole: it is split by rows into a few pieces a shard.

Tokens are counted as words (``[^\\x20\\x09-\\x0D]+``); in scripts that put no blanks
between words, each character counts as one.

Defined cases: a null text has size 1 and is equal to other null texts; repeated
rows each get a slot; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .exchange import partitions

#: Buckets that pool small groups, and the least share of a shard that makes a group an item of its own.
BUCKETS, OWN_SHARE = 4096, 1e-3
#: Pieces that a group is measured in, for the case that it must be split.
GRAINS = 1024


def tokens_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words of each document; a character of a script without blanks (Thai, Lao, Burmese, Khmer, kana, Han) is one by itself."""
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[offs[:-1][np.diff(offs) > 0]] |= word[offs[:-1][np.diff(offs) > 0]]
    high = np.flatnonzero(buf >= 0xE0)
    if len(high):  # their characters have three bytes, the first two of which tell the script
        a, b = buf[high], buf[np.minimum(high + 1, len(buf) - 1)]
        alone = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b <= 0x81) | (b == 0x9E) | (b == 0x9F))
        alone |= (a == 0xE3) & (b >= 0x81) & ((b <= 0x83) | (b >= 0x90)) | (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)
        at = high[alone]
        begins[at] = True
        after = at + 3
        after = after[after < len(buf)]
        begins[after] |= word[after]  # what follows them begins anew
    total = np.concatenate([[0], np.cumsum(begins)])
    return np.diff(total[offs])


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows: its sizes)."""
    total = np.maximum(items.sum(axis=0), 1)
    v = items / total * shards  # 1: a shard's capacity
    room = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        out[i] = int(np.argmax(room @ v[i]))
        room[out[i]] -= v[i]
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows ``id, size, text_crc32, law, shard, slot, grown_shard``, one for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    known = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(known) + 1).cast("long").alias("size"),
        F.crc32(known).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("h"),
        F.xxhash64(F.lit(7), text).alias("h2"),
        F.pmod(F.xxhash64(F.lit(3), F.monotonically_increasing_id()), F.lit(GRAINS)).cast("int").alias("grain"),  # settled below
        known.alias("_t"),
    )
    names = rows.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tc.text_buffers(b.column("_t"))
            for i, j in tc.slices(offs):
                tokens = tokens_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in names), pa.array(tokens, pa.int64())], names=[*names, "tokens"])

    kind = rows.schema["_id"].dataType.simpleString()
    rows = store.settle(rows.mapInArrow(count, f"_id {kind}, size long, text_crc32 long, h long, h2 long, grain int, tokens long"), "shard-rows")  # without the texts
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    if not total.n:
        return _result(rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")), id_col)
    cap = total.bytes / shards
    grains = rows.groupBy("h", "h2", "grain").agg(*sums)
    groups = grains.groupBy("h", "h2").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.collect_list(F.struct("grain", "bytes", "tokens", "n")).alias("grains"))
    large = (F.col("bytes") >= OWN_SHARE * cap) | (F.col("n") >= max(2, OWN_SHARE * total.n / shards))
    groups = store.settle(groups.withColumn("large", large).withColumn("grains", F.when((F.col("bytes") > cap) | (F.col("n") > total.n / shards), F.col("grains"))), "shard-groups")
    # At most 2 * shards / OWN_SHARE groups are large, and at most 2 * shards of them are split.
    own = groups.where("large").drop("large").collect()
    pooled = groups.where("not large").groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()

    items, keys = [], []
    for g in own:
        pieces = max(1, int(np.ceil(max(g.bytes / cap, g.n * shards / total.n))))
        if pieces == 1 or not g.grains:
            items.append((g.bytes, g.tokens, g.n))
            keys.append((g.h, g.h2, None))
            continue
        pieces = min(GRAINS, 8 * pieces)  # small ones fill what whole shards would leave
        for k in range(pieces):
            part = [x for x in g.grains if x.grain * pieces // GRAINS == k]
            if part:
                items.append(tuple(sum(x[c] for x in part) for c in ("bytes", "tokens", "n")))
                keys.append((g.h, g.h2, [x.grain for x in part]))
    first_pool = len(items)
    items += [(b.bytes, b.tokens, b.n) for b in pooled]
    at = place(np.array(items, float), shards)
    pool = [0] * buckets
    for b, s in zip(pooled, at[first_pool:].tolist()):
        pool[b.bucket] = s
    fixed = spark.createDataFrame([(h, h2, gs, int(s)) for (h, h2, gs), s in zip(keys, at.tolist())], "h long, h2 long, gs array<int>, s int") if keys else None
    pool_shard = F.element_at(F.lit(pool), (F.pmod("h", F.lit(buckets)) + 1).cast("int"))
    if fixed is not None:
        whole = fixed.where("gs is null").select("h", "h2", F.col("s").alias("whole"))
        cut = fixed.where("gs is not null").select("h", "h2", F.explode("gs").alias("grain"), F.col("s").alias("cut"))
        rows = rows.join(F.broadcast(whole), ["h", "h2"], "left").join(F.broadcast(cut), ["h", "h2", "grain"], "left")  # bounded as above
        rows = rows.withColumn("shard", F.coalesce("whole", "cut", pool_shard))
    else:
        rows = rows.withColumn("shard", pool_shard)
    subs = max(partitions(spark), shards) * 2
    rows = store.settle(rows.select("_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64(F.lit(5), "_id", "h", F.monotonically_increasing_id()), F.lit(subs)).cast("int").alias("sub")), "shard-placed")
    counts = rows.groupBy("shard", "sub").count().collect()  # shards x subs numbers
    base, seen = {}, dict.fromkeys(range(shards), 0)
    for c in sorted(counts, key=lambda c: (c.shard, c["sub"])):
        base[c.shard, c["sub"]] = seen[c.shard]
        seen[c.shard] += c["count"]
    offset = F.broadcast(spark.createDataFrame([(*k, v) for k, v in base.items()], "shard int, sub int, base long"))
    w = Window.partitionBy("shard", "sub").orderBy("_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(w)).join(offset, ["shard", "sub"]).withColumn("slot", F.col("base") + F.col("rank") - 1)
    return _result(rows, id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
