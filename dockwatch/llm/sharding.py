"""Documents to shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size. The shards take turns; at its turn a shard claims the first slot of its
order that is still free, until no slot is left. A document's key hashes to a
slot, the slot names the shard: one broadcast lookup, no shuffle of documents.
When a shard leaves, its slots are dealt out again and nearly all others stay.

The table has ``slots`` rows whatever the corpus holds, so its broadcast is
bounded by a parameter.

Defined cases: a null key hashes like the empty string; equal keys (repeated
rows) share a shard; an empty table gives an empty result; weights must be
positive and at least one shard is needed. Columns of the input that carry the
names of the result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table

SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _md5_number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS,
                 weights: list[int] | None = None) -> np.ndarray:
    """The shard (position in ``names``) of every slot.

    The order of shard i is offset + j * skip modulo the table size, both from
    hashes of its name; a prime size makes that a permutation. A weight of w
    gives a shard w turns in each round.
    """
    if not names or not _is_prime(slots):
        raise ValueError("sharding needs at least one shard and a prime number of slots")
    weights = weights or [1] * len(names)
    if len(weights) != len(names) or min(weights) < 1:
        raise ValueError("one positive weight for each shard")
    owner = np.full(slots, -1, dtype=np.int32)
    at = [_md5_number(f"offset:{n}") % slots for n in names]
    skip = [_md5_number(f"skip:{n}") % (slots - 1) + 1 for n in names]
    free = slots
    while free:
        for i, w in enumerate(weights):
            for _ in range(min(w, free)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS,
          weights: list[int] | None = None) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``."""
    spark: SparkSession = df.sparkSession
    owner = lookup_table(names, slots, weights)
    lookup = spark.createDataFrame(
        [(i, names[s]) for i, s in enumerate(owner)], "_slot int, _shard string")
    out = df.withColumn("_slot", slot_of(F.col(key), slots))
    out = out.join(F.broadcast(lookup), "_slot")    # ``slots`` rows, a parameter
    return (out.drop("slot", "shard")
            .withColumnsRenamed({"_slot": "slot", "_shard": "shard"}))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows come from every task, so no task gathers it."""
    df.write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 64 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def oracle() -> str:
    """The same placement in SQL; the filled table is spelled out as text of two digits a slot."""
    def preferences(name: str):
        first, step = _md5_number(f"offset:{name}") % SLOTS, _md5_number(f"skip:{name}") % (SLOTS - 1) + 1
        return ((first + j * step) % SLOTS for j in range(SLOTS))

    names, taken = shard_names(), {}
    order = {n: preferences(n) for n in names}
    while len(taken) < SLOTS:
        for i, n in enumerate(names):
            claim = next((s for s in order[n] if s not in taken), None)
            if claim is not None:
                taken[claim] = i
    digits = "".join(f"{taken[s]:02d}" for s in range(SLOTS))
    return f"""
        WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')),
                                                       1, 15)) AS BIGINT) % {SLOTS} AS s
                   FROM documents),
             t AS (SELECT '{digits}' AS digits)
        SELECT doc_id, CAST(s AS INTEGER) AS slot,
               'shard-00' || substr(digits, CAST(s AS INTEGER) * 2 + 1, 2) AS shard
        FROM d, t"""
