"""Copy statements over lines, libraries, rings; graphs against a plain walk."""

import random
from collections import defaultdict

import pytest

from creditloom.operators import automata, graph
from creditloom.plans import copybooks, jcl

PROGRAM = """       IDENTIFICATION DIVISION.
           COPY ALPHA.
           COPY
               BETA IN MYLIB
      * a comment COPY GAMMA.
               REPLACING ==A== BY ==X.Y== ==B==
               BY ==COPY==.
           DISPLAY 'COPY DELTA. it''s' COPY ONE. COPY TWO OF LIB2.
           MOVE 'open literal COPY ZETA.
      -    'still COPY ETA. ' TO W. COPY THREE. MOVE 1 TO X.
           MOVE "x" TO COPY-FIELD.
  COPY LOOSE.
           COPY UNENDED
           COPY LAST.""".split("\n")
BOOKS = {
    ("DEFAULT", "ALPHA"): ["       01 A.", "           COPY R1."],
    ("DEFAULT", "R1"): ["       01 R1.", "           COPY R2. COPY R3."],
    ("DEFAULT", "R2"): ["       01 R2.", "           COPY R1.", "           COPY R3."],
    ("DEFAULT", "R3"): ["       01 R3.", "           COPY R2.", "           COPY R1."],
    ("MYLIB", "BETA"): ["       05 A PIC X.", "       05 B PIC X."],
    ("DEFAULT", "BETA"): ["       05 WRONG."],
    ("DEFAULT", "ONE"): ["       05 ONE."],
}


@pytest.fixture(scope="module")
def program(spark):
    rows = [("P", i + 1, t) for i, t in enumerate(PROGRAM)] + [("Q", 1, "           COPY ONE."), ("Q", 2, "       01 B."), ("N", 1, None)]
    return spark.createDataFrame(rows, "file string, line_no bigint, text string")


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(b, x, i + 1, t) for (x, b), ts in BOOKS.items() for i, t in enumerate(ts)], "file string, library string, line_no bigint, text string")


def test_statements_over_lines(spark, program, monkeypatch):
    want = {
        ("P", 2, "ALPHA", "DEFAULT", ""), ("P", 3, "BETA", "MYLIB", "==A== BY ==X.Y== ==B== BY ==COPY=="), ("P", 8, "ONE", "DEFAULT", ""), ("P", 8, "TWO", "LIB2", ""),
        ("P", 10, "THREE", "DEFAULT", ""), ("P", 12, "LOOSE", "DEFAULT", ""), ("P", 14, "LAST", "DEFAULT", ""), ("Q", 1, "ONE", "DEFAULT", ""),
    }
    assert {tuple(r) for r in copybooks.copy_statements(program).collect()} == want
    monkeypatch.setattr(automata, "FAN", 3)  # several levels of blocks
    assert {tuple(r) for r in copybooks.copy_statements(program).collect()} == want
    assert [tuple(r) for r in copybooks.unended_copies(program).collect()] == [("P", 13)]
    monkeypatch.setattr(copybooks, "STATEMENT_LINES", 2)
    assert ("P", 3) in {tuple(r) for r in copybooks.unended_copies(program).collect()}
    assert copybooks.copy_statements(program.limit(0)).count() == 0


def test_states_against_a_walk(spark):
    r = random.Random(5)
    rows = [(f, i, r.choice("abc")) for f, n in (("x", 700), ("y", 1), ("z", 90)) for i in range(n)]
    table = {"a": [1, 2, 0], "b": [0, 0, 1], "c": [2, 1, 2]}
    df = spark.createDataFrame(rows, "file string, n int, t string")
    from pyspark.sql import functions as F

    move = automata.token_map(F.array("t"), list(table), list(table.values()))
    got = {(x.file, x.n): x.state for x in automata.states_before(df, ["file"], "n", move, 3).collect()}
    state, want = {}, {}
    for f, i, t in rows:
        want[f, i] = state.get(f, 0)
        state[f] = table[t][want[f, i]]
    assert got == want


def test_expansion_by_library_and_rings(program, books):
    rows = [r for r in copybooks.expand(program.where("text IS NOT NULL"), books).collect()]
    text = [r.text.strip() for r in sorted((r for r in rows if r.file == "P"), key=lambda r: r.place)]
    assert text[:5] == ["IDENTIFICATION DIVISION.", "* >>>BEGIN COPY ALPHA FROM DEFAULT/ALPHA<<<", "01 A.", "* >>>BEGIN COPY R1 FROM DEFAULT/R1<<<", "01 R1."]
    assert "05 X.Y PIC X." in text and "05 WRONG." not in text and "* a comment COPY GAMMA." in text
    assert text.count("* >>>CIRCULAR COPY: R1<<<") == 2 and sum("BEGIN COPY R2" in t for t in text) == 1  # a ring is run through once
    at = text.index("DISPLAY 'COPY DELTA. it''s'")
    assert text[at + 1 : at + 5] == ["* >>>BEGIN COPY ONE FROM DEFAULT/ONE<<<", "05 ONE.", "* >>>END COPY ONE<<<", "* >>>UNRESOLVED COPY: TWO<<<"]
    assert "MOVE 1 TO X." in text and "MOVE 'open literal COPY ZETA." in text
    status = {(r.library, r.copybook): (r.depth, r.status, r.ring) for r in copybooks.closure(program.where("file = 'P'"), books).collect()}
    assert status["DEFAULT", "R3"] == (3, "circular", "DEFAULT/R1") and status["MYLIB", "BETA"] == (1, "resolved", None) and status["LIB2", "TWO"][1] == "unresolved"


def walks(edges):
    ahead, nodes = defaultdict(set), set()
    for a, b in edges:
        ahead[a].add(b)
        nodes |= {a, b}
    far = {}
    for s in nodes:
        seen, front, k = {}, [s], 0
        while front:
            k += 1
            front = [v for u in front for v in ahead[u] if v not in seen and not seen.update({v: k})]
        far[s] = seen
    return far, {n: min([m for m in nodes if m in far[n] and n in far[m]] + [n]) for n in nodes}


def test_components_and_distances(spark):
    r = random.Random(1)
    edges = [(f"c{r.randint(0, 60)}", f"c{r.randint(0, 60)}") for _ in range(65)] + [(f"b{r.randint(0, 15)}", f"b{r.randint(0, 15)}") for _ in range(60)]
    edges += [(f"r{i:03}", f"r{(i + 1) % 70:03}") for i in range(70)] + [(f"l{i:03}", f"l{i + 1:03}") for i in range(70)] + [("l030", "side"), ("side", "side")]
    df = spark.createDataFrame(edges, "src string, dst string")
    far, comp = walks(edges)
    found = graph.strong_components(df).collect()
    assert {x.node: x.component for x in found} == comp and len(found) == len(comp)
    some = ["l000", "r005", *sorted(comp)[:5]]
    sources = spark.createDataFrame([(s,) for s in some], "node string")
    want = {(s, v, k) for s in some for v, k in far[s].items()}
    for shorten in (True, False):
        if shorten or len(edges) < 100:
            assert {tuple(x) for x in graph.reach(df, sources, shorten).collect()} == want
    assert graph.strong_components(df.limit(0)).count() == 0 and graph.reach(df.limit(0), sources).count() == 0


def test_lineage_of_given_sources_follows_long_chains(spark):
    chain = [(f"{'PGM' if i % 2 else 'DSN'}:N{i}", f"{'DSN' if i % 2 else 'PGM'}:N{i + 1}") for i in range(300)] + [("DSN:R", "PGM:R"), ("PGM:R", "DSN:R")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    hops = {r.target: r.hops for r in jcl.data_lineage(edges, spark.createDataFrame([("N0",), ("R",)], "dataset string")).collect()}
    assert hops["N300"] == 150 and hops["R"] == 1 and len(hops) == 151
    assert {(r.node, r.component) for r in jcl.lineage_groups(edges).collect()} == {("DSN:R", "DSN:R"), ("PGM:R", "DSN:R")}
