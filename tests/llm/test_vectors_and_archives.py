"""Hard negatives, whitening and archives against brute force, and on awkward tables."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import hard_negatives, warc, whitening
from creditloom.session import scratch_path

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, x int, block int, n string, component string"


def vectors_of(spark, rows):
    """``(vec_id, embedding, label)`` rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, v, label, "k", 1, 2, "n", "c") for i, v, label in rows], VECTORS)


def vector_rows(seed=3, n=240, d=6, copies=60):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(0, 0.3, d).astype(np.float32).tolist(), int(r.integers(0, 4))) for i in range(n)]
    same = rows[10][1]
    rows += [(n + i, same, i % 3) for i in range(copies)]
    bad = [(900, None, 1), (901, [0.1, None, 0.2, 0.3, 0.1, 0.0], 1), (902, [float("nan")] * d, 2), (903, [float("inf")] * d, 0)]
    return rows + bad + [(904, [0.5, 0.5], 1), (905, [], 2), (906, same, None), (907, [0.0] * d, 1), rows[5], rows[5]]


def brute_hard_negatives(rows, step, k=5):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v) or len(v) != 6:
            continue
        good[i, label, tuple(math.floor(256 * c) for c in v)] = True
    out = set()
    for i, label, x in good:
        if i % step:
            continue
        score = {(j, l, y): sum(a * b for a, b in zip(x, y)) for j, l, y in good}
        first = lambda keep: sorted((-s, j) for (j, l, y), s in score.items() if keep(j, l, s))[:k]
        for s, j in first(lambda j, l, s: l == label and j != i):
            p = -s
            for rank, (q, m) in enumerate(first(lambda j, l, s: l != label and 80 * p <= 100 * s <= 100 * p), 1):
                out.add((i, j, rank, m, p, -q))
    return out


@pytest.mark.parametrize("tree, block, stride", [(1024, 8192, 4096), (5, 40, 16)])
def test_hard_negatives(spark, monkeypatch, tree, block, stride):
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "STRIDE", stride)
    rows = vector_rows()
    got = [tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, rows), lambda i: i % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hard_negatives(rows, 10)


def test_hard_negatives_of_little(spark):
    anchor = lambda i: i % 10 == 0
    assert hard_negatives.hard_negatives(vectors_of(spark, []), anchor).count() == 0
    assert hard_negatives.hard_negatives(vectors_of(spark, [(3, [1.0], 1), (4, [1.0], 2)]), anchor).count() == 0
    huge = [(0, [1e30, -1e30], 1), (1, [1e30, -1e30], 1), (2, [1e30, -1e30], 2)]
    (row,) = hard_negatives.hard_negatives(vectors_of(spark, huge), anchor).collect()
    assert row.negative_id == 2 and row.positive_score == row.negative_score == 2 * hard_negatives.MOST**2


def test_spanning_tree_is_least():
    x = np.random.default_rng(1).integers(-50, 50, (40, 3))
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[order[0]] == -1
    place = {int(v): i for i, v in enumerate(order)}
    assert all(place[int(p)] < place[v] for v, p in enumerate(parent) if p >= 0)
    links = sorted((np.sqrt(((x[i] - x[j]) ** 2).sum()), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for d, i, j in links:
        if root[i] != root[j]:
            total += d
            root = [root[j] if r == root[i] else r for r in root]
    assert edge.sum() == pytest.approx(total)


def test_bounds_leave_rows_out_where_anchors_are_near():
    r = np.random.default_rng(2)
    rows = r.integers(-60, 60, (2000, 8))
    bounds = hard_negatives.Bounds(rows, 60)
    parent, child = rows[0], rows[0] + r.integers(-1, 2, 8)
    low, high = bounds.open(-1, 0.0)
    bounds.rescore(parent, np.arange(2000), low, high)
    bounds.kept[0] = (low, high)
    low, high = bounds.open(0, float(np.sqrt(((parent - child) ** 2).sum())))
    true = rows @ child
    assert (low <= true).all() and (true <= high).all()
    assert (high >= np.sort(true)[-5]).sum() < 400  # a fifth of the rows and less could still be among the best five


def test_inertia_counts():
    r = np.random.default_rng(4)
    for d in (1, 2, 7, 20):
        a = r.normal(size=(d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
            assert whitening.below(a, shift) == (values < shift).sum()
    zero = np.array([[0.0, 1.0], [1.0, 0.0]])  # no single entry can be the pivot
    assert whitening.below(zero, 0.0) == 1


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [9, 9, 9, 1, 0], [1, 1 - 1e-9, 0.5, 0, 0], [0, 0, 0, 0, 0], [1e-8, 1e-9, 1e8, 1, 3]])
def test_eigenpairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(5, 5)))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.eigenpairs(a, 5)
    size = max(1.0, max(values))
    assert np.allclose(got, sorted(values, reverse=True), rtol=0, atol=1e-12 * size)
    assert np.allclose(vectors @ vectors.T, np.eye(5), atol=1e-6)
    assert np.abs(a @ vectors.T - vectors.T * got).max() < 1e-12 * size


def test_whitening(spark):
    rows = vector_rows() + [(None, [0.1] * 6, 3)]
    got = whitening.whiten(vectors_of(spark, rows).repartition(3), 4).collect()
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    n, total = len(good), [sum(x) for x in zip(*[x for _, x in good])]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, total)] for _, x in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ vectors[:, ::-1] / np.sqrt(values[::-1])
    want = defaultdict(list)
    for (i, x), w in zip(good, white):
        for c in range(4):
            want[i, c + 1].append((sum((n * a - s) ** 2 for a, s in zip(x, total)), w[c]))
    assert len(got) == 4 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        near = min(want[r.vec_id, r.component], key=lambda t: (t[0] != r.deviation, abs(abs(t[1]) - abs(r.whitened))))
        assert near[0] == r.deviation and abs(near[1]) == pytest.approx(abs(r.whitened), rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
        if abs(near[1]) > 1e-6:
            assert sign.setdefault(r.component, near[1] * r.whitened > 0) == (near[1] * r.whitened > 0)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], 1)] * 3)).count() == 0  # no spread
    two = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], 1), (2, [0.25, 0.5], 1)])).collect()
    assert [r.component for r in two] == [1, 1] and {round(abs(r.whitened), 9) for r in two} == {1.0}
    huge = whitening.whiten(vectors_of(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and {r.component for r in huge} >= {1}


EVIL = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LIAR = "WARC/1.0\r\nContent-Length: 999999\r\n\r\n"


def page_rows(seed=4, n=60):
    r = random.Random(seed)
    bits = ["ab é ", "\r\n", "\r\n\r\n", "WARC/", "WARC/1.", EVIL, LIAR, "x" * 50, "\n"]
    rows = [(i, f"http://a/{i}\r\nContent-Length: 3", None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(n + i * 7 % 20, "u", rows[5][2] + "y" * 1200) for i in range(20)]
    rows += [(None, "u", rows[-1][2]), (None, None, "z" * 2000), (None, None, "z" * 2000), (400, "q", "z" * 3), (401, "q", "z" * 3), (402, "q", "")]
    return rows + [(400, "q", "w" * 3000), (400, "q", "w" * 3000), (399, "q", "w" * 3000), (403, "long", "WARC/1.1\r\n" * 20_000)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"path": F.lit(1), "digest": F.lit("x"), "payload": F.lit(2), "at": F.lit(3)})


def brute_archive(rows, least=1000):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        last = max((x for x in groups[h or ""] if x is not None), default=None) if len(data) >= least else p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if p == last else "revisit", None if p == last else last))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["9001", "128m"])
def test_archives(spark, split):
    rows = page_rows()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = warc.archived_pages(pages_of(spark, rows).repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted([(r.page_id, r.full_bytes, r.full_sha1, r.record_type, r.original_id) for r in out], key=repr) == brute_archive(rows)
    assert all(r.complete and (r.record_type == "revisit" or r.stated_digest == r.payload_sha1) for r in out)


def test_archive_payloads_and_ends(spark):
    rows = [(i, "u", h) for i, h in enumerate(["<p>one</p>", f"<p>{EVIL}</p>{LIAR}", "", "three"])]
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages_of(spark, rows).coalesce(1), path)
    got = warc.read_warc(spark, path).orderBy("offset").collect()
    assert [bytes(r.payload).decode() for r in got] == [h for _, _, h in rows]
    assert [r.end for r in got][:-1] == [r.offset for r in got][1:] and got[0].offset == 0
    whole = "".join(spark.read.text(path, wholetext=True).toPandas()["value"])
    assert [whole[r.offset : r.offset + 8] for r in got] == ["WARC/1.1"] * 4 and len(whole) == got[-1].end
    # A file cut short, one that starts with something else, one with a wrong length, one record of another kind.
    damaged = {
        "short": whole[:-10],
        "other": "junk" + whole,
        "wrong": whole.replace("Content-Length: ", "Content-Length: 1", 1),
        "info": "WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n" + whole,
    }
    found = {}
    for name, text in damaged.items():
        at = scratch_path(spark, "warc-damaged")
        spark.createDataFrame([(text[:-1],)], "value string").coalesce(1).write.option("lineSep", text[-1]).text(at)
        found[name] = warc.read_warc(spark, at).orderBy("offset").collect()
        assert len(warc.read_warc(spark, at, payloads=False).collect()) == len(found[name])
    assert [r.complete for r in found["short"]] == [True, True, True, False] and found["other"] == []
    assert len(found["wrong"]) <= 1 and [bytes(r.payload) for r in found["info"]][0] == b"abc" and len(found["info"]) == 5


def test_archives_of_nothing(spark):
    assert warc.archived_pages(pages_of(spark, page_rows()).limit(0)).count() == 0
