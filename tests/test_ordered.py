"""Ordered and matching operators against brute force on skewed fixtures."""

import random

from pyspark.sql import functions as F

from creditloom.operators import matching, ordered


def skewed(n=400, seed=3):
    """Half of the rows belong to one key."""
    rnd = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        k = "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}"
        at[k] = at.get(k, 0) + rnd.randint(1, 3)
        rows.append((k, at[k], rnd.randint(-9, 9), rnd.choice([None, None, "a", "b"])))
    return rows


def test_running_values_across_blocks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, pos long, v long, m string").repartition(5)
    out = ordered.running(df, ["k"], "pos", {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("m"))}, block_rows=7)
    out = ordered.previous(out, ["k"], "pos", "p", F.col("m"), block_rows=5)
    got = {(r.k, r.pos): (r.s, r.lo, r.l, r.p) for r in out.collect()}
    state, want = {}, {}
    for k, pos, v, m in rows:
        s, lo, l, p = state.get(k, (0, 99, None, None))
        want[k, pos] = (s + v, min(lo, v), m or l, p)
        state[k] = (s + v, min(lo, v), m or l, m)
    assert got == want


def test_dense_ids_with_one_repeated_value(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r.id: r.n for r in ordered.dense_ids(df, [F.col("v").desc(), F.col("id").asc()], "n", slices=6).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_page_counts(spark):
    starts, _ = ordered.paginate(F.col("id") + 1)
    breaks = spark.range(602).where(starts).count()
    assert 5 + 602 + 2 * breaks + 4 == 633


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_match(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))
    names, cands = sorted({word() for _ in range(60)}), [word() for _ in range(60)]
    got = {
        r.name: (r.candidate, r.distance)
        for r in matching.fuzzy_match(
            spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c, i) for i, c in enumerate(cands)], "candidate string, position long")
        ).collect()
    }
    for n in names:
        near = [(lev(n, c), i, c) for i, c in enumerate(cands) if lev(n, c) <= 2]
        assert got[n] == ((min(near)[2], min(near)[0]) if near else (None, None)), n


def test_longest_literal(spark):
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("aAb ") for _ in range(n))
    lits = [("f", f"p{i}", make(rnd.randint(1, 20)), i) for i in range(40)]
    texts = sorted({make(rnd.randint(0, 40)) for _ in range(40)})
    got = {
        r.text: (r.owner, r.literal_len)
        for r in matching.longest_literal(
            spark.createDataFrame([("f", t) for t in texts], "file string, text string"), spark.createDataFrame(lits, "file string, owner string, literal string, position long"), "file"
        ).collect()
    }
    for t in texts:
        hits = [(-len(l), i, o) for _, o, l, i in lits if l.lower() in t.lower()]
        assert got[t] == ((min(hits)[2], -min(hits)[0]) if hits else (None, None)), t


def test_running_values_over_far_apart_positions(spark):
    rows = [(k, p * 2**40, v, m) for k, p, v, m in skewed(seed=5)]
    df = spark.createDataFrame(rows, "k string, pos long, v long, m string").repartition(5)
    out = ordered.running(df, ["k"], "pos", {"s": ("sum", F.col("v")), "l": ("last", F.col("m"))}, sparse=True)
    out = ordered.previous(out, ["k"], "pos", "p", F.col("v"), sparse=True)
    got = {(r.k, r.pos): (r.s, r.l, r.p) for r in out.collect()}
    state, want = {}, {}
    for k, pos, v, m in rows:
        s, l, p = state.get(k, (0, None, None))
        want[k, pos] = (s + v, m or l, p)
        state[k] = (s + v, m or l, v)
    assert got == want
    numbers = ordered.number_by_id(df.select("pos").distinct(), "pos", "n").collect()
    assert [r.n for r in sorted(numbers)] == list(range(1, len(numbers) + 1))


def test_blocks_of_a_hot_key_are_dealt_apart(spark):
    """Also where the rows come in dealt by the key alone."""
    df = spark.createDataFrame(skewed(), "k string, pos long, v long, m string")
    joined = df.join(df.groupBy("k").agg(F.count("*").alias("n")).hint("merge"), "k")
    plan = ordered.running_sum(joined, ["k"], "pos", "s", F.col("v"), block_rows=7)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(k#" in line and "_blk#" in line for line in plan.splitlines())


def test_looking_for_one_block_changes_no_value(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 9, -3), ("b", 3, None), (None, 1, 1), ("c", 4, 2)]
    aggs = {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "l": ("last", F.col("v"))}
    for more in ([], [("a", 17, 4), ("b", 12, 1)]):  # one block of ten positions, then two
        df = spark.createDataFrame(rows + more, "k string, p bigint, v bigint")
        plain, looked = ([tuple(r) for r in ordered.running(df, ["k"], "p", aggs, 10, look=x).orderBy("k", "p").collect()] for x in (False, True))
        assert plain == looked and len(plain) == len(rows) + len(more) - 1
    shuffles = [ordered.running(df.where("p < 10"), ["k"], "p", aggs, 10, look=x)._jdf.queryExecution().sparkPlan().toString().count("Exchange") for x in (False, True)]
    assert shuffles[1] == 1 < shuffles[0]
