"""Edit scripts: replay, kept pairs, and length against a longest common subsequence."""

import random

import pytest

from creditloom.operators import alignment


def common(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shortest_scripts():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        pairs = alignment.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:])) and len(pairs) == common(a, b)
    assert alignment.aligned(["x", *"abcdef", "y"], ["x", *"uvwxyz", "y"], 3) == [(0, 0), (7, 7)]


def test_heaviest_increasing():
    r = random.Random(2)
    for _ in range(200):
        start = r.sample(range(100), r.randint(0, 9))
        weight = [r.randint(1, 5) for _ in start]
        got = alignment.heaviest_increasing(alignment.np.array(start), alignment.np.array(weight)).tolist()
        assert all(start[i] < start[j] and i < j for i, j in zip(got, got[1:]))
        best = max(sum(w for k, w in enumerate(weight) if m >> k & 1) for m in range(1 << len(start)) if (lambda c: c == sorted(c))([s for k, s in enumerate(start) if m >> k & 1]))
        assert sum(weight[i] for i in got) == best


def files(seed=3):
    r = random.Random(seed)
    base, new = {}, {}
    for f, n in (("small", 8), ("long", 120), ("repeats", 90), ("moved", 100)):
        text = [f"line {i}" if f != "repeats" else r.choice(["", "x", "y"]) for i in range(n)]
        other = text[60:] + text[:60] if f == "moved" else [t if r.random() > 0.1 else r.choice(["new", "", t + "!"]) for t in text if r.random() > 0.1]
        base[f], new[f] = text, other[:20] + ["inserted"] * 3 + other[20:]
    base["gone"], new["fresh"], base["same"], new["same"] = ["a", "b"], ["c"], ["q"] * 70, ["q"] * 71
    return base, new


def table(spark, content):
    rows = [(f, 10 * i + 3, t if t or i % 2 else None) for f, ts in content.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "file string, line_no bigint, text string")


@pytest.mark.parametrize("gap", [4000, 30])
def test_replay(spark, monkeypatch, gap):
    monkeypatch.setattr(alignment, "GAP_LINES", gap)
    base, new = files()
    rows = alignment.edit_script(table(spark, base), table(spark, new)).collect()
    for f in {*base, *new}:
        mine = [r for r in rows if r.file == f]
        old = sorted((r.baseline_line, r.text) for r in mine if r.op != "add")
        now = sorted((r.actual_line, r.text) for r in mine if r.op != "delete")
        assert [t for _, t in old] == base.get(f, []) and [t for _, t in now] == new.get(f, [])
        kept = sorted((r.baseline_line, r.actual_line) for r in mine if r.op == "keep")
        assert all(x < y and u < v for (x, u), (y, v) in zip(kept, kept[1:]))
        best = common(base.get(f, []), new.get(f, []))
        assert len(kept) == best if gap == 4000 else len(kept) >= (0.3 if f == "repeats" else 0.8) * best
    assert alignment.edit_script(table(spark, base).limit(0), table(spark, new).limit(0)).count() == 0
