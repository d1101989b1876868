"""Exact deduplication: lookups in a minimal perfect hash over the distinct digests seen so far.

Every distinct text is known by its SHA-256. Digests are dealt to shards of bounded size; each shard becomes one
index row: displacements per bucket, and for each slot the full digest, the winner's id and the number of copies. No
slot is empty and no two digests share one. A lookup takes one displacement and one slot and compares all 32 bytes of
the digest, so a digest that was never indexed is told apart for certain.

Copies are folded to one row per distinct digest before anything is shuffled by digest or shard: a text held by a
third of all rows is one row there. Only the last join spreads results to documents again; its hot keys are split by
AQE's skew join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import load, query, rows_of, stage

#: Digests in a shard, on average: bounds the memory of one build or lookup.
SHARD = 16_384
#: Digests in a bucket, on average.
BUCKET = 3
_TRIES = 256


def _parts(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8")
    return (words[:, 0] % np.uint64(buckets)).astype(np.int64), words[:, 1]


def _slot(keys: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    x = keys + displacement * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def build_index(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket and the slot of every digest; digests: distinct rows of 32 bytes."""
    n = len(digests)
    buckets = n // BUCKET + 1
    bucket, key = _parts(digests, buckets)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    first = np.concatenate(([0], np.cumsum(counts)))
    displacement, slots, taken = np.zeros(buckets, np.uint64), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] == 0:
            break
        members = order[first[b] : first[b + 1]]
        start = 0
        while True:
            tries = np.arange(start, start + _TRIES, dtype=np.uint64)
            place = _slot(key[members][None, :], tries[:, None], n)
            good = ~taken[place].any(axis=1)
            if len(members) > 1:
                ranked = np.sort(place, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                displacement[b], slots[members] = tries[at], place[at]
                taken[place[at]] = True
                break
            start += _TRIES
    return displacement, slots


def _digest_matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


INDEX = "shard bigint, displacement binary, digests binary, winners binary, copies binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _digest_matrix(group["digest"])
    displacement, slots = build_index(digests)
    order = np.argsort(slots)
    winner = group["winner"]
    known = winner.notna().to_numpy()
    # A winner that has no id is written as the smallest long.
    ids = np.where(known, winner.fillna(0).to_numpy(np.int64), np.iinfo(np.int64).min)
    row = (
        int(group["shard"].iloc[0]),
        displacement.astype("<u4").tobytes(),
        digests[order].tobytes(),
        ids[order].astype("<i8").tobytes(),
        group["n"].to_numpy(np.int64)[order].astype("<i8").tobytes(),
    )
    return pd.DataFrame([row], columns=["shard", "displacement", "digests", "winners", "copies"])


def _lookup(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    n = len(asked)
    out = pd.DataFrame(
        {
            "digest": asked["digest"],
            "member": np.zeros(n, bool),
            "winner": pd.array([None] * n, "Int64"),
            "copies": np.zeros(n, np.int64),
        }
    )
    if n == 0 or len(index) == 0:
        return out
    row = index.iloc[0]
    displacement = np.frombuffer(row["displacement"], "<u4").astype(np.uint64)
    held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    digests = _digest_matrix(asked["digest"])
    bucket, key = _parts(digests, len(displacement))
    slot = _slot(key, displacement[bucket], len(held))
    member = (held[slot] == digests).all(axis=1)
    winners = np.frombuffer(row["winners"], "<i8")[slot]
    none = ~member | (winners == np.iinfo(np.int64).min)
    out["member"] = member
    out["winner"] = pd.arrays.IntegerArray(np.where(none, 0, winners), none)
    out["copies"] = np.where(member, np.frombuffer(row["copies"], "<i8")[slot], 0)
    return out


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, digest) per document; a row that repeats both id and text is the same document."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
    ).distinct()


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def digest_index(distinct: DataFrame, shards: int) -> DataFrame:
    """Index rows (one per shard) over distinct digests with their winners and counts."""
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_build, INDEX)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which document stays of every group of equal texts.

    Returns one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    * Without `history`, the documents are their own history: the largest id of a group stays.
    * With `history` (same columns), a document whose text occurs there is a repeat: keep_id is the largest id of that
      text in the history, group_size counts both tables, kept is false. Texts that do not occur there are grouped
      among themselves.
    * Null text counts as empty; empty texts are equal to each other. Nothing is normalised.
    * A null id is smaller than any other: it stays only in a group without known ids (keep_id is null then).
    * Rows repeating id and text are one document and count once. One id with two texts is two documents.
    * Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows = stage(digest_rows(docs, id_col, text_col), "digests")
    own = stage(_distinct(rows), "distinct")
    past = own if history is None else stage(_distinct(digest_rows(history, id_col, text_col)), "history")
    shards = rows_of(past) // SHARD + 1
    index = digest_index(past, shards)
    asked = own.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).select("shard", "digest")
    found = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(
        _lookup, "digest binary, member boolean, winner bigint, copies bigint"
    )
    if history is None:
        ruled = found.select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("past"))
    else:
        ruled = found.join(own.withColumnRenamed("winner", "own_winner"), "digest").select(
            "digest",
            F.when(F.col("member"), F.col("winner")).otherwise(F.col("own_winner")).alias("keep_id"),
            (F.col("copies") + F.col("n")).alias("group_size"),
            F.col("member").alias("past"),
        )
    return rows.join(ruled, "digest").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (~F.col("past") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without repeats, all columns kept (pipeline stage): of every group of equal texts the largest doc_id.

    Of rows repeating doc_id and text, the one with the smallest hash of its other columns stays.
    """
    ruled = exact_dedup(docs).filter("kept")
    first = stage(ruled.select(_key("doc_id").alias("__key"), F.unhex("text_sha256").alias("__digest")), "kept")
    keyed = docs.withColumns(
        {"__key": _key("doc_id"), "__digest": F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))}
    )
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.row_number().over(Window.partitionBy("__key", "__digest").orderBy(F.xxhash64(*others) if others else F.lit(0)))
    kept = keyed.join(first, ["__key", "__digest"], "left_semi").withColumn("__rank", rank)
    return kept.filter("__rank = 1").select(*docs.columns)


def _key(id_col: str) -> Column:
    """An id to join on: null takes the smallest long."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def _op6(spark, sf_dir):
    return exact_dedup(load(spark, sf_dir, "documents"))
