"""Hard negatives by anchors on spanning trees, whose scores bound each other's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.ordered import dense_ids
from creditloom.session import cut

#: Anchors of one tree; rows of one block; rows that are bounded at a time; random directions that order the anchors.
TREE, BLOCK, STRIDE, DIRECTIONS = 1_024, 8_192, 4_096, 12
#: Whole components beyond this size count as this size: a score of up to 500 components fits a long.
MOST = 2**27
_BEST = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_BEST_SQL = "key bigint, slot int, vec_id bigint, score bigint"


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Distinct ``key, vec_id, label, x``: components as ``floor(scale * component)``, at most ``MOST`` in size.

    Left out: a null id, label or vector, null or non-finite components, and vectors of another length than most
    (ties: the longer).  ``key`` tells rows apart that share an id.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = good.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * scale))).cast("bigint")).alias("x"),
    )
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    n = sizes[0]["n"] if sizes else 0
    return rows.where(F.size("x") == n).distinct().select(F.xxhash64("vec_id", "label", "x").alias("key"), "vec_id", "label", "x")


def _matrix(column) -> np.ndarray:
    rows = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.int64).reshape(rows, -1)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning tree by Euclidean distance, from the first row on: preorder, and each row's parent and edge length."""
    n = len(x)
    y = x.astype(float)
    square = (y * y).sum(axis=1)
    parent, far, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    at = 0
    parent[0] = -1
    open_[0] = False
    for _ in range(n - 1):
        d = square + square[at] - 2 * (y @ y[at])
        closer = open_ & (d < far)
        far[closer], parent[closer] = d[closer], at
        at = int(np.where(open_, far, np.inf).argmin()) if open_.any() else at
        open_[at] = False
        children[parent[at]].append(at)
    order, todo = [], [0]
    while todo:
        v = todo.pop()
        order.append(v)
        todo += reversed(children[v])
    edge = np.array([np.sqrt(((y[v] - y[p]) ** 2).sum()) if p >= 0 else 0.0 for v, p in enumerate(parent)])
    return np.array(order), parent, edge


def _with_tree(table: pa.Table) -> pa.Table:
    """Anchors of one group with ``place`` (preorder), ``parent`` (its place) and ``edge``."""
    table = table.sort_by([("vec_id", "ascending"), ("key", "ascending")])
    order, parent, edge = spanning_tree(_matrix(table.column("x")))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    above = np.where(parent >= 0, place[parent], -1)
    columns = {"place": pa.array(place), "parent": pa.array(above), "edge": pa.array(edge)}
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table


def grouped_anchors(anchors: DataFrame, seed: int = 11) -> DataFrame:
    """Anchors in groups of at most ``TREE``, near ones together: ordered by the signs of their products with random directions.

    Adds ``group, place, parent, edge``: the spanning tree of each group, built once.
    """

    def signs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x")).astype(float)
            ways = np.random.default_rng(seed).normal(size=(x.shape[1], DIRECTIONS))
            code = ((x @ ways) > 0) @ (1 << np.arange(DIRECTIONS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64))], names=[*batch.schema.names, "code"])

    columns = "key bigint, vec_id bigint, label bigint, x array<bigint>"
    coded = anchors.select("key", "vec_id", "label", "x").mapInArrow(signs, f"{columns}, code bigint")
    placed = dense_ids(coded, [F.col("code"), F.col("vec_id"), F.col("key")], "_at")
    groups = placed.select("key", "vec_id", "label", "x", F.floor((F.col("_at") - 1) / TREE).cast("bigint").alias("group"))
    return cut(groups.groupBy("group").applyInArrow(_with_tree, f"{columns}, group bigint, place bigint, parent bigint, edge double"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(score) > k:
        border = np.partition(score, len(score) - k)[len(score) - k]
        above, level = np.flatnonzero(score > border), np.flatnonzero(score == border)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        keep = np.concatenate([above, level])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


class Bounds:
    """Scores of a stretch of rows with one anchor after another along their tree: exact where they were asked for, else an interval.

    A row's score with a child lies within its score with the parent plus or minus the edge times the row's norm.
    """

    def __init__(self, rows: np.ndarray, top: int):
        # Products of integers are exact in doubles while they stay below 2^53; beyond that Python integers take over.
        most = int(np.abs(rows).max(initial=0))
        self.exact = most * top * max(1, rows.shape[1]) < 2**52
        self.rows = rows.astype(float) if self.exact else rows.astype(object)
        self.norm = np.sqrt((rows.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.asked = 0

    def open(self, parent: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        if parent < 0:
            wide = np.full(len(self.norm), np.inf)
            return -wide, wide
        low, high = self.kept[parent]
        reach = edge * (1 + 1e-12) * self.norm
        slack = 1e-12 * (np.abs(low) + np.abs(high)) + 1e-6 if not self.exact else 1e-6
        return low - reach - slack, high + reach + slack

    def rescore(self, anchor: np.ndarray, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Exact scores at the positions ``some``; the intervals close around them."""
        a = anchor.astype(self.rows.dtype)
        score = ((self.rows @ a)[some] if 2 * len(some) > len(self.norm) else self.rows[some] @ a).astype(np.int64)
        self.asked += len(some)
        low[some] = high[some] = score.astype(float)
        return score


def _search(anchors: pa.Table, rows: pa.Table, wanted, k: int) -> pa.Table:
    """The best ``k`` rows of a block for each slot of each anchor; ``wanted(anchor)`` gives label, sign and windows of score."""
    out: dict[str, list] = {c: [] for c in _BEST.names}
    if not anchors.num_rows or not rows.num_rows:
        return _BEST.empty_table()
    anchors = anchors.sort_by("place")
    place = np.asarray(anchors.column("place"))
    parents, edges = np.asarray(anchors.column("parent")), np.asarray(anchors.column("edge"))
    tree = _matrix(anchors.column("x"))
    last_child = {int(p): int(c) for c, p in zip(place, parents)}  # in preorder the last one wins
    described = anchors.drop_columns(["x"]).to_pylist()
    ids, labels, x = np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), _matrix(rows.column("x"))
    top = int(np.abs(tree).max(initial=0))
    best: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in described]
    for at in range(0, len(ids), STRIDE):
        here, mine, of = slice(at, at + STRIDE), ids[at : at + STRIDE], labels[at : at + STRIDE]
        bounds = Bounds(x[here], top)
        for i, anchor in enumerate(described):
            low, high = bounds.open(int(parents[i]), float(edges[i]))
            same, windows = wanted(anchor)
            fit = (of == anchor["label"]) == same
            if same:
                fit &= mine != anchor["vec_id"]
            near = np.zeros(len(mine), bool)
            for slot, bottom, ceiling in windows:
                have = best[i].get(slot)
                floor = bottom if have is None or len(have[0]) < k else max(bottom, have[0][-1])
                near |= (high >= float(floor) * (1 - 1e-12 * np.sign(float(floor))) - 1) & (low <= float(ceiling) * (1 + 1e-12 * np.sign(float(ceiling))) + 1)
            some = np.flatnonzero(near & fit) if parents[i] >= 0 else np.arange(len(mine))
            if len(some):
                score = bounds.rescore(tree[i], some, low, high)
                right = fit[some]
                score, who = score[right], mine[some][right]
                for slot, bottom, ceiling in windows:
                    inside = (score >= bottom) & (score <= ceiling)
                    if inside.any():
                        s, w = score[inside], who[inside]
                        if slot in best[i]:
                            s, w = np.concatenate([best[i][slot][0], s]), np.concatenate([best[i][slot][1], w])
                        keep = _best(s, w, k)
                        best[i][slot] = (s[keep], w[keep])
            own, above = int(place[i]), int(parents[i])
            if own in last_child:
                bounds.kept[own] = (low, high)
            if above >= 0 and last_child[above] == own:  # nobody asks for the parent's intervals any more
                del bounds.kept[above]
    for i, anchor in enumerate(described):
        for slot, (s, w) in best[i].items():
            out["key"] += [anchor["key"]] * len(s)
            out["slot"] += [slot] * len(s)
            out["vec_id"] += w.tolist()
            out["score"] += s.tolist()
    return pa.table(out, schema=_BEST)


def _positives(anchor: dict):
    return True, [(0, -np.inf, np.inf)]


def _negatives(share_low: int, share_high: int):
    """Windows in whole scores: ``share_low * p <= 100 * n <= share_high * p``."""

    def wanted(anchor: dict):
        return False, [(j, -(-share_low * p // 100), share_high * p // 100) for j, p in enumerate(anchor["goals"] or []) if -(-share_low * p // 100) <= share_high * p // 100]

    return wanted


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` per cent of the positive's.

    A score is the integer inner product with the anchor of components ``floor(scale * component)``; higher scores come
    first, ties by smaller id.  Anchors (``is_anchor`` of the id column) are put in groups of at most ``TREE`` near
    ones, each with its spanning tree.  A group meets every row, in blocks of about ``BLOCK``: along the tree, scores
    with the parent and the length of the edge bound those with the child, and only rows whose bounds overlap the
    window, cut from below by the best found so far, are scored again.  Nothing is left out: what a bound excludes
    cannot be in the result.  A block returns a few rows per anchor, so no task grows with a hot label or vector.

    ``vectors`` has ``vec_id, embedding, label``; see ``usable`` for rows that take no part; other columns are ignored.
    Rows that share an id but differ count one by one (an anchor's own id is never its positive); equal rows count once.
    An anchor without positives, and a positive without rows in its window, give no rows; so do empty tables.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    rows = cut(usable(vectors, scale))
    blocks = max(1, -(-rows.count() // BLOCK))
    anchors = grouped_anchors(rows.where(is_anchor(F.col("vec_id"))))
    groups = anchors.select(F.col("group")).distinct()
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # Each block goes to every group: this is the stated set of queries against all rows, dealt in blocks.
    total = groups.count()
    dealt = rows.select("vec_id", "label", "x", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, total - 1)).cast("bigint"))).alias("group"))

    def search(asked: DataFrame, wanted, k: int) -> DataFrame:
        """Cut, so that a later stage reads the few rows found instead of searching again."""
        sent = asked.withColumn("block", spread)
        found = sent.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(lambda a, r: _search(a, r, wanted, k), _BEST_SQL)
        return cut(found)

    def ranked(found: DataFrame, k: int, out: str) -> DataFrame:
        order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)

    near = cut(ranked(search(anchors, _positives, positives), positives, "rank").select("key", "vec_id", "score", "rank"))
    goals = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("_near"))  # ``positives`` entries
    asked = anchors.join(goals, "key", "left").withColumn("goals", F.transform("_near", lambda p: p["score"])).drop("_near")
    hard = ranked(search(asked, _negatives(low, high), negatives), negatives, "_rank")
    goal = near.select("key", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    joined = hard.join(goal, ["key", "slot"]).join(who, "key")
    return joined.select("anchor_id", "positive_id", F.col("_rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
