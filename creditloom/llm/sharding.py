"""Shards of equal row counts that keep linked documents together."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.ordered import dense_ids
from creditloom.session import cut


def _pick(values: list, at: Column) -> Column:
    """``values[at]`` for a list of one entry per shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _per_shard(frame: DataFrame, shards: int, column: str = "shard", amount: Column | None = None) -> list[int]:
    """Rows (or an amount) of each shard: one number per shard comes to the driver."""
    out = [0] * shards
    for s, n in frame.groupBy(column).agg(F.sum(amount if amount is not None else F.lit(1)).alias("n")).collect():
        out[s] = int(n)
    return out


def _propagate(linked: DataFrame, fixed: list[int], shards: int, capacity: int, rounds: int) -> DataFrame:
    """Move documents (``row, link, members, shard``) towards the shard that holds most of their link group."""
    for turn in range(rounds):
        held = linked.groupBy("link", "shard").agg(F.count("*").alias("n"))
        # Cut, so that the join has its own exchanges and a hot link can be split.
        favourite = cut(held.groupBy("link").agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("to")))
        wishes = linked.join(favourite, "link")
        here = [a + b for a, b in zip(fixed, _per_shard(linked, shards))]
        wanted = _per_shard(wishes.where("to <> shard"), shards, "to")
        leaving = _per_shard(wishes.where("to <> shard"), shards)
        # Shards with room, and what is about to leave them, admit a share of the wishes: whole groups where they fit.
        room = [max(0, capacity - here[s] + leaving[s]) for s in range(shards)]
        share = [min(1.0, room[s] / wanted[s]) if wanted[s] else 0.0 for s in range(shards)]
        big = F.col("members") > _pick(room, F.col("to"))
        draw = F.pmod(F.when(big, F.xxhash64("row", F.lit(turn))).otherwise(F.xxhash64("link", F.lit(turn))), F.lit(1 << 30)) / float(1 << 30)
        goes = (F.col("to") != F.col("shard")) & (draw < _pick(share, F.col("to")))
        linked = cut(wishes.select("row", "link", "members", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        if not any(wanted):
            break
    return linked


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = 4, slack: float = 1.2) -> DataFrame:
    """Deal documents to shards whose row counts differ by one at most, equal texts together where they fit.

    Balanced label propagation: documents start in a shard drawn from their id; in each round the documents of a link
    group (equal texts) wish to move to the shard that holds most of the group, and shards admit wishes up to their
    room, which is ``slack`` times the even share.  A group larger than a shard is split.  At last, rows beyond a shard's exact quota (unlinked ones first) go to
    the places left free, in order, so that groups stay in a piece.  Links are groups, never pairs; per round Spark
    joins documents with one row per group, and only one number per shard reaches the driver.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null text has no bytes, and is linked like the
    empty text.  Repeated rows each take a place.  Returns one row per input row:
    ``doc_id, size`` (UTF-8 bytes plus 8), ``text_crc32, link, shard, slot`` (gapless from 0 in a shard).
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("link"),
        )
    )
    total = rows.count()
    members = cut(rows.groupBy("link").agg(F.count("*").alias("members")).where("members > 1"))
    row = F.struct("doc_id", "size", "text_crc32")
    drawn = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    started = cut(rows.join(members, "link", "left").select(row.alias("row"), "link", "members", drawn.alias("shard")))
    alone, linked = started.where("members is null"), started.where("members is not null")
    linked = _propagate(linked, _per_shard(alone, shards), shards, int(slack * -(-total // shards)), rounds)
    placed = cut(alone.unionByName(linked))
    have = _per_shard(placed, shards)
    # Which shards get one row more: those that hold most now.
    quota = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-have[s], s))[: total % shards]:
        quota[s] += 1
    starts = [0, *accumulate(have)][:shards]
    over = [max(0, h - q) for h, q in zip(have, quota)]
    over_starts = [0, *accumulate(over)][:shards]
    ordered = dense_ids(placed, [F.col("shard"), F.col("members").isNull(), F.col("link"), F.col("row")], "_place")
    rank = F.col("_place") - 1 - _pick(starts, F.col("shard"))
    ranked = ordered.select("row", "link", "shard", rank.alias("rank"))
    stays = F.col("rank") < _pick(quota, F.col("shard"))
    number = _pick(over_starts, F.col("shard")) + F.col("rank") - _pick(quota, F.col("shard"))
    # The k-th surplus row takes the k-th free place.
    free = [max(0, q - h) for h, q in zip(have, quota)]
    free_ends = list(accumulate(free))
    to, slot = F.lit(0), F.lit(0).cast("bigint")
    for s in reversed(range(shards)):
        if free[s]:
            fits = number < free_ends[s]
            to = F.when(fits, F.lit(s)).otherwise(to)
            slot = F.when(fits, number - (free_ends[s] - free[s]) + have[s]).otherwise(slot)
    return ranked.select(
        "row.*", "link",
        F.when(stays, F.col("shard")).otherwise(to).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("bigint").alias("slot"),
    )


def sharded_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (existing columns of these names are replaced); repeated rows take a place each."""
    placed = shard_rows(docs, **settings).select("doc_id", "size", "text_crc32", "link", "shard", "slot")
    plain = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.coalesce("text", F.lit(""))
    mine = docs.select(
        F.struct(*plain).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), (F.octet_length(text) + 8).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_link"),
    )
    mine = mine.withColumn("_no", F.row_number().over(Window.partitionBy("_doc", "_size", "_crc", "_link").orderBy(F.xxhash64("_row"))))
    told = placed.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32", "link").orderBy("shard", "slot")))
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_size") == F.col("size")) & (F.col("_crc") == F.col("text_crc32")) & (F.col("_link") == F.col("link")) & (F.col("_no") == F.col("no"))
    return mine.join(told, same).select("_row.*", "shard", "slot")
