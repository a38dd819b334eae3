"""Finite-state machines over ordered rows, scanned in parallel.

A row turns each state a machine may be in into the state behind the row.  Such maps compose, so blocks of rows are
reduced to one map each, blocks of blocks likewise, and the states are then handed down again: rows of one key need
not meet in one task, and the number of levels grows with the logarithm of the longest key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import idiv
from creditloom.session import cut

#: Rows that are folded at a time.
FAN = 256


def token_map(tokens: Column, classes: list[str], table: list[list[int]]) -> Column:
    """The map of one row: from each state through all its tokens.

    ``table[c][s]`` is the state after a token equal to ``classes[c]`` in state ``s``; other tokens change nothing.
    """
    states = len(table[0])
    flat = F.array(*[F.lit(x) for row in table for x in row])
    known = F.filter(F.transform(tokens, lambda t: F.array_position(F.array(*[F.lit(c) for c in classes]), t)), lambda c: c > 0)
    step = lambda s, c: F.element_at(flat, ((c - 1) * states + s + 1).cast("int"))
    walked = F.transform(F.array(*[F.lit(s) for s in range(states)]), lambda s: F.aggregate(known, s, step))
    same = F.array(*[F.lit(s) for s in range(states)])
    return F.when(F.size(known) == 0, same).otherwise(walked)


def _blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of ``FAN`` neighbouring positions with their cells in order."""
    placed = cells.withColumn("_block", idiv(F.col("_pos"), FAN))
    return placed.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_pos", "_map"))).alias("_cells"))


def states_before(df: DataFrame, keys: list[str], pos: str, move: Column, states: int, start: int = 0, out: str = "state") -> DataFrame:
    """Rows with the state in which the machine reaches them.

    ``move`` is the map of a row (an array with one entry per state).  Positions are unique within their keys, not
    negative, and lie close together; null positions and keys take no part.  ``df`` is read twice: materialize it if it is
    costly.
    """
    base = df.where(F.col(pos).isNotNull())
    level = base.select(*keys, F.col(pos).cast("bigint").alias("_pos"), move.alias("_map"))
    levels = []
    same = F.array(*[F.lit(s) for s in range(states)])
    compose = lambda cells: F.aggregate(cells, same, lambda m, c: F.transform(m, lambda s: F.element_at(c["_map"], s + 1)))
    while True:
        blocks = cut(_blocks(level, keys))
        levels.append(blocks)
        level = blocks.select(*keys, F.col("_block").alias("_pos"), compose(F.col("_cells")).alias("_map"))
        if blocks.where(F.col("_block") > 0).isEmpty():
            break
    entered = level.select(*keys, F.col("_pos").alias("_block"), F.lit(start).alias("_in"))
    for blocks in reversed(levels):
        walk = F.aggregate(
            "_cells",
            F.struct(F.col("_in").alias("now"), F.array().cast("array<struct<_pos:bigint,_in:int>>").alias("seen")),
            lambda acc, c: F.struct(
                F.element_at(c["_map"], acc["now"] + 1).alias("now"),
                F.array_append(acc["seen"], F.struct(c["_pos"].alias("_pos"), acc["now"].alias("_in"))).alias("seen"),
            ),
        )["seen"]
        cells = blocks.join(entered, [*keys, "_block"]).select(*keys, F.explode(walk).alias("_c"))
        entered = cut(cells.select(*keys, F.col("_c._pos").alias("_block"), F.col("_c._in").alias("_in")))
    found = entered.select(*keys, F.col("_block").alias("_pos"), F.col("_in").alias(out))
    return base.withColumn("_pos", F.col(pos).cast("bigint")).join(found, [*keys, "_pos"]).select(*[base[c] for c in df.columns], out)
