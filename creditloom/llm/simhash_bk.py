"""SimHash near-duplicates linked through BK-trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.components import components
from creditloom.session import cut

#: Fingerprints of one shard of trees, and queries that walk one copy of a shard.
SHARD = 50_000
QUERIES = 8_192
#: The same where shingle sets travel along: entries of a shard, and nodes of one block of a large key.
SHARD_SETS = 8_192
BLOCK = 1_024
#: Shingles up to which a set is searched for without the radius.
SMALL_SET = 16
BLOCKS = 4


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:e], 42) for a, e in zip(starts[:last], ends[min(size, len(words)) - 1 :])], dtype=np.uint64
    )


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it; no hashes: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash of a text's shingles."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp`` of each row's text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = np.array([fingerprint(t or b"", size) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class BKTrees:
    """A forest: one BK-tree per key, children under integer Hamming distances to their parent.

    All trees are built at once, level by level: the first fingerprint of a group is the node, the others go to its
    child group at their distance.
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        order = np.argsort(keys, kind="stable")
        group = keys[order]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        self.root_keys, self.roots = group[new], order[new]
        rest, node = order[~new], self.roots[np.cumsum(new) - 1][~new]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[node]).astype(np.int64)
            by = np.lexsort((rest, d, node))
            rest, node, d = rest[by], node[by], d[by]
            new = np.ones(len(rest), bool)
            new[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            child = rest[new]
            self.parent[child], self.edge[child] = node[new], d[new]
            node = child[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        kids = np.flatnonzero(self.parent >= 0)
        # Children by (parent, edge) in one sorted array, for range look-ups.
        code = self.parent[kids] * 128 + self.edge[kids]
        by = np.argsort(code, kind="stable")
        self.kids, self.codes = kids[by], code[by]

    def links(self, keys: np.ndarray, queries: np.ndarray, radius: int):
        """Pairs (query position, node position) within ``radius``, batch by batch, along edges that can hold them."""
        at = np.searchsorted(self.root_keys, keys)
        query, node = np.arange(len(queries)), self.roots[at]
        while len(query):
            d = np.bitwise_count(queries[query] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.codes, node * 128 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.codes, node * 128 + np.minimum(d + radius, 64), side="right")
            count = high - low
            many = np.repeat(np.arange(len(query)), count)
            inside = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
            query, node = query[many], self.kids[low[many] + inside]


def _shrink(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _forest_links(table: pa.Table, radius: int) -> pa.Table:
    """Links of one shard, thinned to a star per local component: no link is lost, no pairs are listed."""
    fps = np.asarray(table.column("fp")).view(np.uint64)
    keys = np.asarray(table.column("key"), dtype=np.int64)
    asks = np.asarray(table.column("asks"))
    trees = BKTrees(keys, fps)
    label = np.arange(len(fps))
    ask = np.flatnonzero(asks)
    for at in range(0, len(ask), 2048):
        some = ask[at : at + 2048]
        for q, node in trees.links(keys[some], fps[some], radius):
            a, b = _shrink(label)[some[q]], node
            while True:
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
                np.minimum.at(label, a, b)
                label = _shrink(label)
    linked = np.flatnonzero(label != np.arange(len(label)))
    signed = fps.view(np.int64)
    return pa.table({"a": signed[label[linked]], "b": signed[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints (column ``fp``) within ``radius`` differing bits.

    Within 3 bits, two fingerprints agree on one of 4 blocks of 16 bits, so trees stand on (block, value) keys, which
    are dealt into shards of about ``SHARD`` entries.  A key with over ``QUERIES`` fingerprints has its queries split
    over copies of its tree; a copy is bounded by the key.  No tree goes to the driver.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be below {BLOCKS}")
    n = fps.count()
    shards = BLOCKS * n // SHARD + 1
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535).cast("bigint")) + (i << 16) for i in range(BLOCKS)])).alias("key")
    )
    large = keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > QUERIES).select("key", F.ceil(F.col("_n") / QUERIES).alias("_copies"))
    split = keyed.join(large, "key", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    dealt = split.select("fp", "key", "_copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("copy"))
    dealt = dealt.select(
        "fp", "key", (F.pmod(F.xxhash64("fp"), F.col("_copies")) == F.col("copy")).alias("asks"),
        F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).alias("shard"),
    )
    return dealt.groupBy("shard").applyInArrow(lambda t: _forest_links(t, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and component of each document.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles of ``size`` words (fewer words: all
    of them) are hashed with XXH64, seed 42, repeats included.  Documents link where fingerprints differ in at most
    ``radius`` bits.  A text without words, or null, has fingerprint zero and links like any other.

    Returns one row per input row: ``doc_id, fp`` (signed), ``component_id`` (smallest reachable ``doc_id``; null
    ids count only where a component has no other).  Equal fingerprints are one node, whatever their number.
    """
    marked = cut(fingerprints(docs, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(nodes.select("fp"), radius)
    found = components(edges).withColumnRenamed("node", "fp").withColumnRenamed("component", "root")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    per_fp = cut(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return marked.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def _band_keys(shingles: np.ndarray, bands: int) -> list[int]:
    """One key for each pair of least hashes of a shingle set, under hash functions that depend on the band alone."""
    factors = np.random.default_rng(7).integers(1, 2**62, 2 * bands, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = shingles ^ (shingles >> np.uint64(31))
    least = np.array([(mixed * f).min() for f in factors], dtype="<u8")
    return [xxhash.xxh64_intdigest(least[2 * i : 2 * i + 2].tobytes(), i) for i in range(bands)]


def content_of(docs: DataFrame) -> Column:
    """A text as a 64-bit number; rows are told apart by id and content."""
    return F.xxhash64(docs["text"])


def _shingle_sets(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """``doc_id``, ``content`` (hash of the text), ``node`` (hash of its shingle set) and its ``fp`` and ``keys``; with no bands, ``node`` and ``shingles``."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", size)) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            if bands:
                fps = np.array([majority(x) for x in sets], dtype=np.uint64).view(np.int64)
                keys = [np.array(_band_keys(x, bands) if len(x) else [], np.uint64).view(np.int64) for x in sets]
                more = [pa.array(fps), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(nodes), *more], names=["doc_id", "content", "node", "fp", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content_of(docs).alias("content"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, content bigint, node bigint, fp bigint, keys array<bigint>" if bands else "node bigint, shingles binary")


def _verified_links(table: pa.Table, radius: int, similarity: float) -> pa.Table:
    """Links of one shard: tree searches find candidates, shingle sets decide; thinned to a star per local component."""
    fps = np.asarray(table.column("fp")).view(np.uint64)
    trees = np.asarray(table.column("tree"), dtype=np.int64)
    nodes, first, at = np.unique(np.asarray(table.column("node")), return_index=True, return_inverse=True)
    forest = BKTrees(trees, fps)
    column = table.column("shingles")
    sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in first]
    sizes = np.array([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marked = np.zeros(int(sizes.sum()) + 1, bool)
    label = np.arange(len(nodes))
    # Queries by tree, in steps whose pairs stay few even where each search reads its whole tree.
    order = np.argsort(trees, kind="stable")
    largest = int(np.unique(trees, return_counts=True)[1].max())
    step = max(1, 2_000_000 // largest)
    few = sizes[at[order]] <= SMALL_SET
    rounds = [(part[begin : begin + step], reach) for part, reach in ((order[~few], radius), (order[few], 64)) for begin in range(0, len(part), step)]
    for some, reach in rounds:
        asked, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, node in forest.links(trees[some], fps[some], reach):
            a, b = at[some[q]], at[node]
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            # A small set finds its larger neighbours too, as they do not search as far.
            fit = ((a < b) if reach == radius else (a != b)) & (low >= similarity * high - 1) & (label[a] != label[b])
            asked.append(a[fit])
            found.append(b[fit])
        asked, found = np.concatenate(asked), np.concatenate(found)
        by = np.argsort(asked, kind="stable")
        asked, found = asked[by], found[by]
        cuts = np.flatnonzero(np.diff(asked)) + 1
        for a, near in zip(asked[np.r_[0, cuts]] if len(asked) else [], np.split(found, cuts)):
            near = near[label[near] != label[a]]
            if not len(near):
                continue
            marked[ids[a]] = True
            starts = np.cumsum(sizes[near]) - sizes[near]
            both = np.add.reduceat(marked[np.concatenate([ids[b] for b in near])], starts, dtype=np.int64)
            marked[ids[a]] = False
            for b in near[both / (sizes[a] + sizes[near] - both) >= similarity]:
                x, y = sorted((label[a], label[b]))
                if x != y:
                    label[label == y] = x
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": nodes[label[linked]], "b": nodes[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _similar_nodes(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 24, bands: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id, content, node``, and the ``root`` node of each node's component.

    Components are those of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Words are as in ``near_duplicates``; texts with one shingle set are one node (by its 64-bit hash), texts without
    words, or null, are one node too.  Three bits only find texts that hardly differ, so trees here stand on ``bands``
    keys of two least shingle hashes, searches reach ``radius`` bits, and shingle sets confirm every link.  Two texts at
    0.8 miss all 10 keys with a chance of 4 in 100,000; more bands make that smaller.  Only texts that share a key send
    their shingles.  A key with over ``BLOCK`` nodes is dealt by pairs of blocks, so that a task holds at most two
    blocks of a key and no pair is left out.

    Small sets differ in more bits at the same similarity, so those of up to ``SMALL_SET`` shingles are searched without
    the radius.
    """
    rows = docs
    marked = cut(_shingle_sets(rows, size, bands))
    described = cut(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("least"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    nodes = described.select("node", "least")
    keyed = described.select("node", "fp", F.explode("keys").alias("key"))
    # Close texts share most keys: of keys with the same nodes, told by count and two sums of hashes, one is enough.
    shared = keyed.groupBy("key").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")
    )
    shared = shared.where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key", "_n")
    entries = cut(keyed.join(shared, "key"))
    wanted = entries.select("node").distinct().join(nodes, "node")
    wanted = wanted.select(F.col("least.doc_id").alias("_id"), F.col("least.content").alias("_content"))
    texts = rows.join(wanted, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (content_of(rows) == F.col("_content")), "left_semi")
    sets = _shingle_sets(texts, size, 0).groupBy("node").agg(F.first("shingles").alias("shingles"))
    blocks = F.ceil(F.col("_n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    others = F.when(blocks == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda x: x != own)
    )
    dealt = entries.select("node", "fp", "key", own.alias("_own"), F.explode(others).alias("_other"))
    dealt = dealt.withColumn("tree", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    dealt = cut(dealt.select("node", "fp", "tree"))
    shards = dealt.count() // SHARD_SETS + 1
    ready = dealt.join(sets, "node").select("node", "fp", "tree", "shingles", F.pmod("tree", F.lit(shards)).alias("shard"))
    edges = ready.groupBy("shard").applyInArrow(lambda t: _verified_links(t, radius, similarity), "a bigint, b bigint")
    found = components(edges).withColumnRenamed("component", "root")
    roots = cut(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"))
    return marked.select("doc_id", "content", "node"), roots


def similar_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per ``doc_id`` and node: ``doc_id, node, component_id`` (the smallest ``doc_id`` of the component).

    Components and settings are those of ``_similar_nodes``.  Rows without an id join components, but are not returned.
    """
    rows, roots = _similar_nodes(docs, **settings)
    least = cut(roots.groupBy("root").agg(F.min("least.doc_id").alias("component_id")))
    per_node = cut(roots.join(least, "root").select("node", "component_id"))
    return rows.where(F.col("doc_id").isNotNull()).select("doc_id", "node").distinct().join(per_node, "node").select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component: that with the smallest ``doc_id`` (rows without id last), ties by content.

    Components and settings are those of ``_similar_nodes``.  Rows are told apart by id and content, so rows that share
    an id but not a text are kept unless they are near copies of others, and rows without id take part.
    """
    rows, roots = _similar_nodes(docs, **settings)
    first = cut(roots.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.content").alias("_content")).distinct())
    keep = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (content_of(docs) == F.col("_content"))
    kept = docs.join(first, keep, "left_semi")
    return kept.withColumn("_text", content_of(docs)).dropDuplicates(["doc_id", "_text"]).drop("_text")
