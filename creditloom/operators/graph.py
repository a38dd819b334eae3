"""Directed graphs as edge tables (src, dst): strong components, contracted paths, distances from sources.

Long stretches without branches are contracted by pointer doubling first, so rounds grow with the logarithm of their
length; what is left is usually small.  Every round works on the edges or pairs of all keys at once and is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import cut


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _follow(links: DataFrame) -> DataFrame:
    """Where each node's links end: (node, end, hops, ring, least).

    ``links(node, to)`` has one row per node.  ``end`` is the first node without a link, ``hops`` the links to it; nodes
    that only lead around are a ring, named by its ``least`` node.
    """
    names = links.select(F.col("node").alias("to"), F.lit(True).alias("_more"))
    state = links.join(names, "to", "left").select(
        "node", "to", F.lit(1).cast("bigint").alias("hops"), F.least("node", F.when(F.col("_more"), F.col("to")).otherwise(F.col("node"))).alias("least"), F.col("_more").isNull().alias("arrived")
    )
    state = cut(state)
    while True:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("arrived").alias("_arrived"))
        j = state.join(ahead, "to", "left")
        go = ~F.col("arrived")
        pick = lambda new, old: F.when(go, new).otherwise(F.col(old))
        state = cut(
            j.select(
                "node", pick(F.col("_to"), "to").alias("to"), pick(F.col("hops") + F.col("_hops"), "hops").alias("hops"), pick(F.least("least", "_least"), "least").alias("least"),
                pick(F.col("_arrived"), "arrived").alias("arrived"), (go & (F.col("_arrived") | (F.col("_least") < F.col("least")))).alias("_busy"),
            )
        )
        if state.where("_busy").isEmpty():
            return state.select("node", F.col("to").alias("end"), "hops", (~F.col("arrived")).alias("ring"), "least")


def contract(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with unbranched stretches made one: core (src, dst, length), passed nodes (node, first, offset, last, rest), rings (node, ring).

    A node with one way in and one way out, other than itself, is passed unless ``keep(node)`` holds it.  ``offset`` is its
    distance from ``first``, ``rest`` that to ``last``.  Rings consist of passed nodes only.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.max("src").alias("from"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_out"), F.max("dst").alias("to"))
    single = into.join(out, "node").where("_in = 1 AND _out = 1 AND from <> node").select("node", "from", "to")
    if keep is not None:
        single = single.join(keep.select("node").distinct(), "node", "left_anti")
    single = cut(single)
    ahead = _follow(single.select("node", "to"))
    behind = _follow(single.select("node", F.col("from").alias("to")))
    rings = ahead.where("ring").select("node", F.col("least").alias("ring"))
    passed = cut(
        ahead.where(~F.col("ring")).select("node", F.col("end").alias("last"), F.col("hops").alias("rest")).join(
            behind.where(~F.col("ring")).select("node", F.col("end").alias("first"), F.col("hops").alias("offset")), "node"
        ).select("node", "first", "offset", "last", "rest")
    )
    short = edges.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(single.select(F.col("node").alias("dst")), "dst", "left_anti")
    long = passed.where("offset = 1").select(F.col("first").alias("src"), F.col("last").alias("dst"), (F.col("rest") + 1).alias("length"))
    core = short.select("src", "dst", F.lit(1).cast("bigint").alias("length")).unionByName(long).groupBy("src", "dst").agg(F.min("length").alias("length"))
    return cut(core), passed, rings


def _least_before(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The least (order, node) that reaches each node, itself included: (node, found).  Labels of labels are taken too, so ways halve."""
    labels = cut(nodes.select("node", F.struct("order", "node").alias("found")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("src"), "found"), "src").groupBy("dst").agg(F.min("found").alias("_near"))
        low = labels.join(near.withColumnRenamed("dst", "node"), "node", "left").select("node", "found", F.least("found", "_near").alias("_low"))
        far = labels.select(F.col("node").alias("_at"), F.col("found").alias("_far"))
        moved = cut(
            low.withColumn("_at", F.col("_low.node")).join(far, "_at").select("node", F.least("_low", "_far").alias("_new"), (F.least("_low", "_far") < F.col("found")).alias("_moved"))
        )
        labels = moved.select("node", F.col("_new").alias("found"))
        if moved.where("_moved").isEmpty():
            return labels


def strong_components(edges: DataFrame, trims: int = 3) -> DataFrame:
    """Strongly connected components: (node, component), named by their least node; nodes alone are components.

    Rounds of trimming (nodes without a way in or out), contracting unbranched stretches, and colouring: each node
    takes the least node that reaches it and the least it reaches, under an order drawn anew each time.  Where both
    are the same node it belongs to that node's component; edges between nodes that differ in either lie in none.
    """
    start = cut(_clean(edges))
    nodes = start.select(F.col("src").alias("node")).unionByName(start.select(F.col("dst").alias("node"))).distinct()
    live = cut(start.where("src <> dst"))
    found: DataFrame | None = None
    passed_by_round: list[DataFrame] = []
    add = lambda df: df if found is None else found.unionByName(df)
    salt = 0
    while not live.isEmpty():
        size = live.count()
        for _ in range(trims):
            held = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            held = cut(held)
            left = held.count()
            live, shrunk = held, left < size
            size = left
            if not shrunk or not left:
                break
        if not size:
            break
        core, passed, rings = contract(live)
        found = cut(add(rings.select("node", F.col("ring").alias("component"))))
        passed_by_round.append(passed.select("node", "first", "last"))
        live = cut(core.select("src", "dst").where("src <> dst"))
        if live.isEmpty():
            break
        salt += 1
        around = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().select("node", F.xxhash64("node", F.lit(salt)).alias("order"))
        around = cut(around)
        down = _least_before(live, around)
        up = _least_before(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), around)
        both = cut(down.withColumnRenamed("found", "_down").join(up.withColumnRenamed("found", "_up"), "node").select("node", F.col("_down.node").alias("_down"), F.col("_up.node").alias("_up")))
        found = cut(add(both.where("_down = _up").select("node", F.col("_down").alias("component"))))
        rest = both.where("_down <> _up")
        side = lambda c: rest.select(F.col("node").alias(c), F.struct("_down", "_up").alias(f"_{c}"))
        live = cut(live.join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("src", "dst"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    for passed in reversed(passed_by_round):  # a passed node lies on a way around if its two ends do
        comp = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))  # noqa: E731, B023
        j = passed.join(comp("first"), "first", "left").join(comp("last"), "last", "left")
        a, b = F.coalesce("_first", "first"), F.coalesce("_last", "last")
        found = cut(found.unionByName(j.where(a == b).select("node", a.alias("component"))))
    whole = cut(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("_root")))
    names = whole.groupBy("_root").agg(F.min("node").alias("component"))
    return whole.join(cut(names), "_root").select("node", "component")


def reach(edges: DataFrame, sources: DataFrame, shorten: bool = True) -> DataFrame:
    """Least distance from each source to every node it reaches: (source, node, distance of 1 or more).

    ``sources(node)``.  A source reaches itself only by a way around.  Unbranched stretches count as one step, so
    rounds grow with the branching, not with the length of a chain; only pairs found anew or nearer go on.
    ``shorten=False`` saves that work where most nodes are sources.
    """
    clean = cut(_clean(edges))
    asked = cut(sources.select("node").where(F.col("node").isNotNull()).distinct())
    core, passed, _ = contract(clean, asked) if shorten else (clean.withColumn("length", F.lit(1).cast("bigint")), None, None)
    step = core.select(F.col("src").alias("node"), F.col("dst").alias("_to"), "length")
    front = asked.join(step, "node").select(F.col("node").alias("source"), F.col("_to").alias("node"), F.col("length").alias("distance"))
    front = best = cut(front)
    while not front.isEmpty():
        grown = front.join(step, "node").groupBy("source", F.col("_to").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
        known = best.withColumnRenamed("distance", "_have")
        front = cut(grown.join(known, ["source", "node"], "left").where(F.col("_have").isNull() | (F.col("distance") < F.col("_have"))).select("source", "node", "distance"))
        best = cut(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    if passed is None:
        return best
    start = asked.select(F.col("node").alias("source"), "node", F.lit(0).cast("bigint").alias("distance"))
    inside = best.unionByName(start).withColumnRenamed("node", "first").join(passed.select("node", "first", "offset"), "first")
    inside = inside.select("source", "node", (F.col("distance") + F.col("offset")).alias("distance"))
    return best.unionByName(inside).groupBy("source", "node").agg(F.min("distance").alias("distance"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The condensation's edges: (src, dst) between different components."""
    side = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    j = _clean(edges).join(side("src"), "src").join(side("dst"), "dst")
    return j.where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
