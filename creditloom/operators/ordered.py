"""Ordered operators that never put a whole key into one task.

A key (one file, one customer) may own a third of all rows, so every running
value is computed in two levels: inside blocks of consecutive positions, then
over the pre-aggregated block totals, then combined.  Rows are always dealt by
key and block, also where the input is already dealt by key alone.  Blocks are
``block_rows`` positions wide; where positions may lie far apart (``sparse``)
they are range slices of the rows instead.  Positions are integers, unique
within their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.pic import idiv
from creditloom.session import cut

BLOCK_ROWS = 200_000


def _local(kind: str, col: Column, w) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col).over(w)


def _total(kind: str, col: Column, pos: str) -> Column:
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), F.col(pos)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _merge(kind: str, carry: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "last":
        return F.coalesce(here, carry)
    return F.least(carry, here) if kind == "min" else F.greatest(carry, here)


def _dealt(df: DataFrame, keys: list[str], pos: str, block_rows: int, sparse: bool) -> DataFrame:
    """Rows with their block ``_blk``, one exchange by key and block."""
    if sparse:
        placed = range_slices(df, [*map(F.col, keys), F.col(pos)]).drop("_at").withColumnRenamed("_slice", "_blk")
    else:
        placed = df.withColumn("_blk", idiv(F.col(pos), block_rows))
    return placed.repartition(*keys, "_blk")


def _one_block(df: DataFrame, pos: str, block_rows: int) -> bool:
    """Whether all positions lie in one block, so that no key has two; reads the positions once."""
    low, high = df.agg(F.min(pos), F.max(pos)).select(*[idiv(F.col(f"{f}({pos})"), block_rows) for f in ("min", "max")]).first()
    return low == high


def running(
    df: DataFrame, keys: list[str], pos: str, aggs: dict[str, tuple[str, Column]], block_rows: int = BLOCK_ROWS, sparse: bool = False, look: bool = False
) -> DataFrame:
    """Add running values up to and including each row.

    ``aggs`` maps a new column to (kind, column); kinds: sum, min, max, and
    last (last non-null, a forward fill).  ``sparse`` writes the rows once.
    ``look`` reads the positions first: if they lie in one block, block totals are not
    computed.  It pays where positions are cheap to read and columns are not.
    """
    base = _dealt(df, keys, pos, block_rows, sparse)
    for name, (_kind, col) in aggs.items():
        base = base.withColumn(f"_in_{name}", col)
    part = [*keys, "_blk"]
    inside = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select(
        "*", *[_local(k, F.col(f"_in_{n}"), inside).alias(f"_loc_{n}") for n, (k, _) in aggs.items()]
    )
    if look and not sparse and _one_block(df, pos, block_rows):
        whole = local
        for c in (*keys, pos):  # as the join below does
            whole = whole.where(F.col(c).isNotNull())
        return whole.select(*df.columns, *[F.coalesce(F.col(f"_loc_{n}"), F.lit(0)).alias(n) if k == "sum" else F.col(f"_loc_{n}").alias(n) for n, (k, _) in aggs.items()])
    totals = base.groupBy(*part).agg(
        *[_total(k, F.col(f"_in_{n}"), pos).alias(f"_tot_{n}") for n, (k, _) in aggs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part, *[_local(k, F.col(f"_tot_{n}"), before).alias(f"_car_{n}") for n, (k, _) in aggs.items()]
    )
    joined = local.join(carry, part)
    return joined.select(
        *[joined[c] for c in df.columns],
        *[_merge(k, F.col(f"_car_{n}"), F.col(f"_loc_{n}")).alias(n) for n, (k, _) in aggs.items()],
    )


def running_sum(
    df: DataFrame, keys: list[str], pos: str, out: str, col: Column, block_rows: int = BLOCK_ROWS, sparse: bool = False
) -> DataFrame:
    return running(df, keys, pos, {out: ("sum", col)}, block_rows, sparse)


def fill_forward(
    df: DataFrame, keys: list[str], pos: str, cols: dict[str, Column], block_rows: int = BLOCK_ROWS, sparse: bool = False, look: bool = False
) -> DataFrame:
    """Last non-null value at or before each row."""
    return running(df, keys, pos, {n: ("last", c) for n, c in cols.items()}, block_rows, sparse, look)


def previous(
    df: DataFrame, keys: list[str], pos: str, out: str, col: Column, block_rows: int = BLOCK_ROWS, sparse: bool = False
) -> DataFrame:
    """The value of the row just before, NULL on the first row of a key."""
    base = _dealt(df, keys, pos, block_rows, sparse).withColumn("_v", F.struct(col.alias("v")))
    part = [*keys, "_blk"]
    local = base.withColumn("_loc", F.lag("_v").over(Window.partitionBy(*part).orderBy(pos)))
    totals = base.groupBy(*part).agg(F.max_by("_v", pos).alias("_tot"))
    carry = totals.select(*part, F.lag("_tot").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_car"))
    joined = local.join(carry, part)
    return joined.select(*[joined[c] for c in df.columns], F.coalesce(F.col("_loc"), F.col("_car"))["v"].alias(out))


def row_numbers(df: DataFrame, keys: list[str], pos: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1-based row number by position within keys."""
    return running_sum(df, keys, pos, out, F.lit(1).cast("bigint"), block_rows)


def range_slices(df: DataFrame, order: list[Column], slices: int | None = None) -> DataFrame:
    """Rows in total order, cut into contiguous slices.

    Adds ``_slice`` (slice number) and ``_at`` (place inside the slice).  The
    order must be total (end with a unique column), so equal leading values
    are split as well.  Slice borders come from a sample, so the result is
    materialized once and every reader sees the same slices.
    """
    parts = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    placed = parts.sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_seq")
    )
    low = F.lit(2**33 - 1).cast("bigint")
    return cut(placed.select("*", F.col("_seq").bitwiseAND(low).alias("_at")).drop("_seq"))


def dense_ids(df: DataFrame, order: list[Column], out: str, slices: int | None = None) -> DataFrame:
    """1-based ids in total order without a global window.

    The only unpartitioned window runs over one row per slice.
    """
    placed = range_slices(df, order, slices)
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_slice", F.coalesce(start, F.lit(0)).alias("_start"))
    # One row per slice: bounded by the partition count, so the hint is safe.
    with_ids = placed.join(F.broadcast(offsets), "_slice")
    return with_ids.select(
        *[with_ids[c] for c in df.columns], (F.col("_start") + F.col("_at") + 1).cast("bigint").alias(out)
    )


def number_by_id(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """1-based numbers in the order of a unique column, however far apart its values lie."""
    return dense_ids(df, [F.col(id_col)], out)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key; Spark trims to n per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def paginate(line_no: Column, first_page: int = 55, later_pages: int = 53) -> tuple[Column, Column]:
    """(starts a page, page number) of the 1-based line; 0 is the opening page."""
    past = line_no - F.lit(first_page + 1)
    starts = (past >= 0) & (past % F.lit(later_pages) == 0)
    page = F.when(past < 0, F.lit(0)).otherwise(idiv(past, later_pages) + F.lit(1)).cast("bigint")
    return starts, page
