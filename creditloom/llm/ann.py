"""Nearest neighbours through learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import cut

#: Vectors the partitions are learned from, at most; rows of one block of a partition; queries that meet it at once.
SAMPLE, BLOCK, QUERIES = 8_192, 16_384, 4_096


@dataclass
class Router:
    """A softmax over partitions: one hidden layer of rectified units."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each sample vector by inner product, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Balanced parts of the neighbour graph: vertices move to the part that most neighbours share while it has room."""
    rng = np.random.default_rng(seed)
    n = len(x)
    # Start from cells around random vectors, filled to capacity nearest first.
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        label = _filled(x @ centre.T, -(-n // parts))
        centre = np.stack([x[label == p].mean(axis=0) if (label == p).any() else centre[p] for p in range(parts)])
    room = int(1.1 * n / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[v].argmax())
            if size[to] < room:
                size[label[v]] -= 1
                size[to] += 1
                label[v] = to
                moved += 1
        if not moved:
            break
    return label


def _filled(score: np.ndarray, capacity: int) -> np.ndarray:
    n, parts = score.shape
    label, size = np.full(n, -1), np.zeros(parts, np.int64)
    for v in np.argsort(-score.max(axis=1), kind="stable"):
        for p in np.argsort(-score[v], kind="stable"):
            if size[p] < capacity:
                label[v], size[p] = p, size[p] + 1
                break
    return label


def train_router(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
    """Learn to which parts the neighbours of a vector belong (Adam, cross entropy against their shares)."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    goal = np.zeros((n, parts), np.float32)
    np.add.at(goal, (np.arange(n), label), 1)
    np.add.at(goal, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
    goal /= goal.sum(axis=1, keepdims=True)
    scale = 1 / max(float(np.linalg.norm(x, axis=1).mean()), 1e-12)
    p = [rng.normal(0, 1.5 * scale, (d, hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            i = order[a : a + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - goal[i]) / len(i)
            gh = (g @ p[2].T) * (h > 0)
            grads = [x[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            t += 1
            for j in range(4):
                m[j] = 0.9 * m[j] + 0.1 * grads[j]
                v[j] = 0.999 * v[j] + 0.001 * grads[j] ** 2
                p[j] -= 0.004 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def learn(vectors: DataFrame, parts: int, k: int = 20) -> Router:
    """Partitions and router from at most ``SAMPLE`` distinct vectors, drawn by a hash of the id."""
    # A share of the rows by a hash, about 9 tenths of SAMPLE where there are more.
    n = vectors.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))) < F.lit(SAMPLE * 9 // 10 if n > SAMPLE else n)
    drawn = sorted(vectors.where(share).collect(), key=lambda r: r["vec_id"])[:SAMPLE]
    x = np.unique(np.array([r["embedding"] for r in drawn], dtype=float), axis=0)
    k, parts = max(1, min(k, len(x) - 1)), max(1, min(parts, len(x) // 4))
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    label = balanced_partition(x, graph, parts)
    return train_router(x, label, graph, parts)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components, not all zero, as doubles."""
    v = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("embedding")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


def _routed(rows: DataFrame, router: Router, top: int, name: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(router)  # its size depends on parts and dimensions only

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            logits = shared.value.logits(_matrix(table.column("embedding")))
            best = np.argsort(-logits, axis=1, kind="stable")[:, :top]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "embedding", name]
            )

    return rows.mapInArrow(run, f"vec_id bigint, embedding array<double>, {name} array<int>")


_FOUND = "query_id bigint, vec_id bigint, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each query; equal vectors are scored once."""
    if not queries.num_rows or not rows.num_rows:
        return _FOUND_ARROW.empty_table()
    ids = np.asarray(rows.column("vec_id").combine_chunks(), dtype=np.int64)
    x, of = np.unique(_matrix(rows.column("embedding")), axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    starts = np.searchsorted(of.ravel()[order], np.arange(len(x)))
    ends = np.append(starts[1:], len(order))
    their = np.asarray(queries.column("vec_id").combine_chunks(), dtype=np.int64)
    q = _matrix(queries.column("embedding"))
    out = {c: [] for c in _FOUND_ARROW.names}
    want = min(k + 1, len(x))
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ x.T
        border = np.partition(rough, len(x) - want, axis=1)[:, len(x) - want]
        for i, query in enumerate(their[a : a + 256].tolist()):
            # Products may differ in their last bits by how they are summed: keep near ties, then sum each alike.
            near = np.flatnonzero(rough[i] >= border[i] - 1e-9 * max(1.0, abs(border[i])))
            exact = (x[near] * q[a + i]).sum(axis=1)
            found = [(-s, v) for s, j in zip(exact.tolist(), near) for v in ids[order[starts[j] : min(ends[j], starts[j] + k + 1)]].tolist() if v != query]
            for s, v in sorted(found)[:k]:
                out["query_id"].append(query)
                out["vec_id"].append(v)
                out["score"].append(-s)
    return pa.table(out, schema=_FOUND_ARROW)


def nearest(vectors: DataFrame, is_query, k: int = 20, parts: int = 16, probes: int = 12) -> DataFrame:
    """The ``k`` nearest rows of each query row by inner product.

    A balanced partitioning of a sample's neighbour graph is learned by a small classifier; every row is indexed under
    its most probable partition, and a query looks into its ``probes`` most probable ones, where products are exact
    (double precision, original vectors).  Partitions are cut into blocks of about ``BLOCK`` rows and queries into
    runs of ``QUERIES``, so no task grows with a hot partition; equal vectors are scored once.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored.  Null, empty and zero vectors, and those with
    null or non-finite components, take no part; vectors must agree in length.  Ids should be unique: rows that share
    an id are candidates one by one, except for queries of that id.  No usable rows give no result.
    Returns ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``.
    """
    rows = usable(vectors)
    if rows.limit(1).count() == 0:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    router = learn(rows, parts)
    parts = len(router.b2)
    placed = cut(_routed(rows, router, min(probes, parts), "parts"))
    placed = placed.withColumn("query", is_query(F.col("vec_id")))
    stored = placed.select("vec_id", "embedding", F.col("parts")[0].alias("part"))
    asked = placed.where("query").select("vec_id", "embedding", F.explode("parts").alias("part"))
    # Rows and queries of each partition: two numbers per partition come to the driver.
    blocks = {p: -(-n // BLOCK) for p, n in stored.groupBy("part").count().collect()}
    runs = {p: -(-n // QUERIES) for p, n in asked.groupBy("part").count().collect()}
    pick = lambda have: F.element_at(F.array(*[F.lit(max(1, have.get(p, 1))) for p in range(parts)]), F.col("part") + 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stored = stored.select("vec_id", "embedding", "part", F.pmod(F.xxhash64("vec_id"), pick(blocks)).cast("int").alias("block"), spread(pick(runs)).alias("run"))
    asked = asked.select("vec_id", "embedding", "part", spread(pick(blocks)).alias("block"), F.pmod(F.xxhash64("vec_id"), pick(runs)).cast("int").alias("run"))
    key = ["part", "block", "run"]
    found = asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(lambda q, r: _search(q, r, k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
