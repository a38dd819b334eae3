"""Edit scripts between two ordered line tables.

Lines that are unique on both sides anchor the alignment; of anchors that cross, the longest increasing subsequence
stays.  Anchors cut a file into gaps, and gaps small enough for a task are aligned line by line there.  No task holds
more than a gap or the runs of crossing anchors of one, both bounded.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ordered import first_n, previous, running, running_sum
from creditloom.session import cut, stored

# The helpers travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines of both sides of a gap that one task aligns; rounds of anchors; runs of anchors that are weighed in one task.
GAP_LINES, ROUNDS, MOST_RUNS = 4_000, 3, 200_000
#: Differences up to which a gap is aligned exactly; beyond it the rest of the gap is replaced.
MOST_EDITS = 600


def heaviest_increasing(start: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of a subsequence with increasing ``start`` and the largest sum of ``weight``; entries are distinct."""
    if not len(start):
        return np.zeros(0, np.int64)
    rank = np.argsort(np.argsort(start)) + 1
    n = len(start)
    best, at = [0] * (n + 1), [-1] * (n + 1)  # a tree of prefix maxima over ranks
    total, back = [0] * n, [-1] * n
    for i in range(n):
        k, top, who = int(rank[i]) - 1, 0, -1
        while k > 0:
            if best[k] > top:
                top, who = best[k], at[k]
            k -= k & -k
        total[i], back[i] = top + int(weight[i]), who
        k = int(rank[i])
        while k <= n:
            if total[i] > best[k]:
                best[k], at[k] = total[i], i
            k += k & -k
    out, i = [], int(np.argmax(total))
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def aligned(a: list[str], b: list[str], most: int = MOST_EDITS) -> list[tuple[int, int]]:
    """Pairs of equal lines that a shortest edit script keeps: furthest reaching paths, edit by edit.

    Where more than ``most`` edits are needed, only the common head and tail are kept.
    """
    head = tail = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    middle: list[tuple[int, int]] = []
    reach, trace = {1: 0}, []
    down = lambda v, d, k: k == -d or (k != d and v[k - 1] < v[k + 1])
    for d in range(min(n + m, most) + 1) if n and m else ():
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if down(reach, d, k) else reach[k - 1] + 1
            while x < n and x - k < m and a[head + x] == b[head + x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        x, y = n, m
        for at in range(d, -1, -1):
            v, k = trace[at], x - y
            to = k + 1 if down(v, at, k) else k - 1
            px, py = (v[to], v[to] - to) if at else (0, 0)
            while x > px and y > py:
                x, y = x - 1, y - 1
                middle.append((head + x, head + y))
            x, y = px, py
        break
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


_SCRIPT = pa.schema([("file", pa.string()), ("op", pa.string()), ("baseline_line", pa.int64()), ("actual_line", pa.int64()), ("text", pa.string())])
SCRIPT = "file string, op string, baseline_line bigint, actual_line bigint, text string"
_GAP = ["file", "gap"]


def _align_gap(table: pa.Table) -> pa.Table:
    """The script of one gap."""
    rows = sorted(table.to_pylist(), key=lambda r: r["line_no"])
    a, b = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
    pairs = aligned([r["text"] for r in a], [r["text"] for r in b])
    kept_a, kept_b = {i for i, _ in pairs}, {j for _, j in pairs}
    out = [(r["file"], "delete", r["line_no"], None, r["text"]) for i, r in enumerate(a) if i not in kept_a]
    out += [(r["file"], "add", None, r["line_no"], r["text"]) for j, r in enumerate(b) if j not in kept_b]
    out += [(a[i]["file"], "keep", a[i]["line_no"], b[j]["line_no"], a[i]["text"]) for i, j in pairs]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCRIPT.types)], schema=_SCRIPT)


def _choose(table: pa.Table) -> pa.Table:
    """Runs of one gap that stay."""
    table = table.sort_by("run")
    keep = heaviest_increasing(np.asarray(table.column("start")), np.asarray(table.column("weight")))
    return table.select([*_GAP, "run"]).take(pa.array(keep, pa.int64()))


def _uncrossed(anchors: DataFrame) -> DataFrame:
    """Anchors (file, gap, b_no, a_no) that can stay together: runs on one diagonal are weighed, the heaviest increasing ones stay.

    Of a gap with more than ``MOST_RUNS`` runs the heaviest are weighed; others give no anchor, and their lines go on.
    """
    ranked = running_sum(anchors, _GAP, "b_no", "_b", F.lit(1).cast("bigint"), sparse=True)
    ranked = stored(running_sum(ranked, _GAP, "a_no", "_a", F.lit(1).cast("bigint"), sparse=True).withColumn("_diagonal", F.col("_a") - F.col("_b")), "anchors")
    seen = previous(ranked, _GAP, "_b", "_before", F.col("_diagonal"))
    numbered = stored(running_sum(seen, _GAP, "_b", "run", (~F.col("_diagonal").eqNullSafe(F.col("_before"))).cast("bigint")), "anchors")
    runs = numbered.groupBy(*_GAP, "run").agg(F.min("_a").alias("start"), F.count("*").alias("weight"))
    runs = cut(runs)
    heavy = runs.groupBy("file", "gap").agg(F.count("*").alias("_n"))
    weighed = runs.join(heavy.where(F.col("_n") <= MOST_RUNS).select(*_GAP), _GAP)
    many = runs.join(heavy.where(F.col("_n") > MOST_RUNS).select(*_GAP), _GAP)
    if not many.isEmpty():
        weighed = weighed.unionByName(first_n(many, _GAP, [F.col("weight").desc(), F.col("run")], MOST_RUNS))
    kept = weighed.groupBy(*_GAP).applyInArrow(_choose, "file string, gap string, run bigint")
    return numbered.join(kept, [*_GAP, "run"], "left_semi").select(*_GAP, "b_no", "a_no")


def edit_script(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Lines to delete, add and keep per file: (file, op, baseline_line, actual_line, text).

    Kept pairs never cross, so deleted and kept lines by ``baseline_line`` are the baseline, and added and kept ones by
    ``actual_line`` the actual file.  Files and gaps of up to ``GAP_LINES`` lines are aligned by a shortest script (up to
    ``MOST_EDITS`` edits); larger ones are first cut at lines unique on both sides, in ``ROUNDS`` rounds, the last of which
    pairs the n-th occurrence of a text with the n-th.  What is larger still is deleted and added.  A null text is
    empty; line numbers are unique per file and side; files on one side only are deleted or added.
    """
    side = lambda df, n: df.select("file", F.lit("").alias("gap"), F.lit(n).alias("side"), F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(side(baseline, 0).unionByName(side(actual, 1)), "lines")
    script = None
    add = lambda df: df if script is None else script.unionByName(df)
    one = F.lit(1).cast("bigint")
    for turn in range(ROUNDS + 1):
        n = lambda s: F.count_if(F.col("side") == s)
        sizes = cut(rows.groupBy(*_GAP).agg(n(0).alias("_b"), n(1).alias("_a")))
        both = (F.col("_b") > 0) & (F.col("_a") > 0)
        small = both & (F.col("_b") + F.col("_a") <= GAP_LINES)
        large = both & ~small
        alone = ~both | large if turn == ROUNDS else ~both
        lines = rows.join(sizes, _GAP)
        missing = F.lit(None).cast("bigint")
        script = add(
            lines.where(alone).select(
                "file", F.when(F.col("side") == 0, "delete").otherwise("add").alias("op"), F.when(F.col("side") == 0, F.col("line_no")).otherwise(missing).alias("baseline_line"),
                F.when(F.col("side") == 1, F.col("line_no")).otherwise(missing).alias("actual_line"), "text",
            )
        )
        script = add(lines.where(small).select(*_GAP, "side", "line_no", "text").groupBy(*_GAP).applyInArrow(_align_gap, SCRIPT))
        if turn == ROUNDS or sizes.where(large).isEmpty():
            return script
        rest = stored(lines.where(large).select(*_GAP, "side", "line_no", "text"), "lines")
        if turn == ROUNDS - 1:
            counted = running_sum(rest, [*_GAP, "side", "text"], "line_no", "_nth", one, sparse=True)
        else:
            counted = rest.withColumn("_nth", one)
        of = lambda s: F.max(F.when(F.col("side") == s, F.col("line_no")))
        pairs = counted.groupBy(*_GAP, "text", "_nth").agg(n(0).alias("_b"), n(1).alias("_a"), of(0).alias("b_no"), of(1).alias("a_no"))
        anchors = stored(pairs.where((F.col("_b") == 1) & (F.col("_a") == 1)).select(*_GAP, "b_no", "a_no"), "anchors")
        chosen = stored(_uncrossed(anchors), "anchors")
        marks = chosen.select(*_GAP, F.lit(0).alias("side"), F.col("b_no").alias("line_no"), F.col("a_no").alias("_other")).unionByName(
            chosen.select(*_GAP, F.lit(1).alias("side"), F.col("a_no").alias("line_no"), F.lit(-1).cast("bigint").alias("_other"))
        )
        marked = rest.join(marks, [*_GAP, "side", "line_no"], "left")
        script = add(marked.where(F.col("_other") >= 0).select("file", F.lit("keep").alias("op"), F.col("line_no").alias("baseline_line"), F.col("_other").alias("actual_line"), "text"))
        placed = running(marked, [*_GAP, "side"], "line_no", {"_part": ("sum", F.col("_other").isNotNull().cast("bigint"))}, sparse=True)
        gap = F.concat("gap", F.lit("."), F.col("_part").cast("string"))
        rows = stored(placed.where(F.col("_other").isNull()).select("file", gap.alias("gap"), "side", "line_no", "text"), "lines")
