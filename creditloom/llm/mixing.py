"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.ordered import dense_ids
from creditloom.session import cut

#: Documents that one fold of the reduction tree pairs off, about.
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``target`` of each source: ``share`` of all sizes by repeating weights, at most ``cap`` times its size.

    ``sources`` has one row per source (``source, source_size``).  Weights repeat over the sources by code point,
    null last.  What a capped source leaves goes to the others by weight; each round is one sum over the sources.
    """
    ranked = cut(dense_ids(sources, [F.col("source").asc_nulls_last()], "_rank"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.select("source", "source_size", weight.cast("double").alias("_w"), (F.col("source_size") * cap).alias("_cap"))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.lit(capped >= 0) & (F.col("_w") * level >= F.col("_cap"))
        x = ranked.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("left"), F.sum(full.cast("int")).alias("n")
        ).first()
        if not x["left"] or x["n"] == capped:
            break
        capped, level = x["n"], max(level, (share * total - x["taken"]) / x["left"])
    return ranked.select("source", "source_size", F.least(F.col("_w") * level, F.col("_cap")).alias("target"))


def _uniform(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _fold(items: Column, kind: str, seed: Column) -> Column:
    """Pair the documents of a block one after another; all but one end whole or empty.

    Mass is counted in words: what one of a pair gives, the other takes, until one of them is full or empty.  The
    direction is drawn so that each keeps its expectation.
    """

    def settled(x: Column, full) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("doc_id", "size", "base")], F.lit(full).alias("full"))

    def carry(x: Column, mass: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("doc_id", "size", "base")], mass.alias("mass"))

    def pair(acc: Column, b: Column) -> Column:
        a = acc["carry"]
        up = F.least(a["size"] - a["mass"], b["mass"])
        down = F.least(a["mass"], b["size"] - b["mass"])
        rise = F.coalesce(_uniform(a["doc_id"], a["size"], b["doc_id"], b["size"], seed) * (up + down) < down, F.lit(False))
        step = F.when(rise, up).otherwise(-down)
        a_full, a_empty = rise & (up >= a["size"] - a["mass"]), ~rise & (down >= a["mass"])
        a_done = a_full | a_empty
        done = F.when(a_full, settled(a, True)).when(a_empty, settled(a, False)).when(rise, settled(b, False)).otherwise(settled(b, True))
        left = F.when(a_done, carry(b, b["mass"] - step)).otherwise(carry(a, a["mass"] + step))
        return F.struct(left.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done"))

    state = f"struct<carry:{kind},done:array<struct<doc_id:bigint,size:bigint,base:int,full:boolean>>>"
    first = F.struct(items[0].alias("carry"), F.array().cast("array<struct<doc_id:bigint,size:bigint,base:int,full:boolean>>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), first.cast(state), lambda acc, b: pair(acc, b).cast(state))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42
) -> DataFrame:
    """How often each document enters a mix in which sources have their target sizes.

    Size is the number of words (null text: 0).  A source's documents all have ``target / source_size`` expected
    copies; the whole part is given to each, and the fractions go through a reduction tree: blocks of about
    ``FAN_IN`` documents of a source, dealt by hash, are folded pairwise, their one open document each goes to the next
    level, until a source has one; that one is rounded to the nearer side.  Pairs keep the sum of words, so a source
    misses its target by at most half of one document.  A hot source has many blocks.  Draws are hashes of ids and
    ``seed``: reruns agree.

    ``docs`` needs ``doc_id, text, source``; others are ignored.  Repeated rows count and are mixed as documents of
    their own (equal rows fall in the same block, so a row should not repeat without bound).  Empty documents take 0
    words in 0 copies.  An empty table gives no rows.
    Returns ``doc_id, source, size, source_size, target, copies, taken``, one row per input row.
    """
    if not 0 < share <= cap:
        raise ValueError("share must be above 0 and not above cap")
    sized = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    targets = cut(targets.join(sources.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_base", F.floor(rate + 1e-12).cast("int")).withColumn("_part", F.greatest(F.lit(0.0), rate - F.col("_base")))
    t = targets.withColumnRenamed("source", "_s")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # A source without words has nothing to give; nor does an empty document.
    plain = (F.col("size") == 0) | (F.col("_part") < 1e-12)
    settled = [rows.where(plain).select("doc_id", "source", "size", F.when(F.col("size") > 0, F.col("_base")).otherwise(0).alias("copies"))]
    open_ = rows.where(~plain).select(
        "source",
        F.struct("doc_id", "size", F.col("_base").alias("base"), (F.col("size") * F.col("_part")).alias("mass")).alias("x"),
        F.col("_n").alias("_open"),
    )
    kind = "struct<doc_id:bigint,size:bigint,base:int,mass:double>"
    most = targets.agg(F.max("_n")).first()[0] or 0
    level = 0
    while most > 0:
        level += 1
        most = -(-most // FAN_IN)
        blocks = F.ceil(F.col("_open") / FAN_IN)
        dealt = open_.select(
            "source", F.col("x").cast(kind).alias("x"), blocks.alias("_open"),
            F.pmod(F.xxhash64("x.doc_id", "x.size", F.lit(seed), F.lit(level)), blocks).alias("_block"),
            F.xxhash64("x.doc_id", "x.size", F.lit(seed + level)).alias("_order"),
        )
        items = F.transform(F.array_sort(F.collect_list(F.struct("_order", "x"))), lambda e: e["x"])
        folded = cut(
            dealt.groupBy("source", "_block", "_open").agg(items.alias("xs")).select("source", "_open", _fold(F.col("xs"), kind, F.lit(seed + level)).alias("f"))
        )
        settled.append(
            folded.select("source", F.explode("f.done").alias("d")).select(
                F.col("d.doc_id"), "source", F.col("d.size"), (F.col("d.base") + F.col("d.full").cast("int")).alias("copies")
            )
        )
        open_ = folded.select("source", F.col("f.carry").alias("x"), "_open")
        if most <= 1:
            settled.append(
                open_.select("x.doc_id", "source", "x.size", (F.col("x.base") + (F.col("x.mass") * 2 >= F.col("x.size")).cast("int")).alias("copies"))
            )
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` says."""
    copies = mix_sources(docs, **settings).select("doc_id", "source", "size", "copies")
    keys = ["doc_id", "source", "size"]
    own = Window.partitionBy(*[f"_{k}" for k in keys])
    # Rows that agree in all three are numbered, so that each meets one decision.
    told = copies.select(*[F.col(k).alias(f"_{k}") for k in keys], "copies").withColumn("_no", F.row_number().over(own.orderBy("copies")))
    mine = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    mine = mine.withColumn("_no", F.row_number().over(own.orderBy(F.xxhash64("_row"))))
    told = told.toDF(*[f"t{c}" for c in told.columns])
    same = F.col("_no") == F.col("t_no")
    for k in keys:
        same &= F.col(f"_{k}").eqNullSafe(F.col(f"t_{k}"))
    kept = mine.join(told, same).where(F.col("tcopies") > 0)
    return kept.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("tcopies"))).alias("_again")).select("_row.*")
