"""Matching joins that avoid comparing everything with everything.

Rows are exploded into many pieces here.  The planner takes those for as small as the rows they came from, so joins of
exploded sides are told to merge; else millions of pieces could be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.session import stored

ANCHOR_WIDTHS = (16, 8, 4, 2, 1)


def deletion_keys(s: Column, max_dist: int) -> Column:
    """Hashes of every string reachable by deleting up to ``max_dist`` characters.

    Two strings within edit distance d always share one such string, so an
    equi-join on these keys finds every pair.
    """

    def one_less(x: Column) -> Column:
        return F.when(
            F.length(x) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(x)),
                lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    level = F.array(s)
    every = level
    for _ in range(max_dist):
        level = F.array_distinct(F.flatten(F.transform(level, one_less)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))


def fuzzy_match(names: DataFrame, candidates: DataFrame, max_dist: int = 2) -> DataFrame:
    """Closest candidate within ``max_dist`` edits; the earliest wins a tie.

    ``names(name)``, ``candidates(candidate, position)``.  Names without a
    partner come out with NULLs.
    """
    left = names.select("name").distinct()
    right = candidates.groupBy("candidate").agg(F.min("position").alias("position"))
    lk = left.select("name", F.explode(deletion_keys(F.col("name"), max_dist)).alias("k"))
    rk = right.select("candidate", "position", F.explode(deletion_keys(F.col("candidate"), max_dist)).alias("k"))
    dist = F.levenshtein(F.col("name"), F.col("candidate"), max_dist)
    pairs = rk.join(lk.hint("merge"), "k").withColumn("distance", dist).where(F.col("distance") >= 0)
    best = pairs.groupBy("name").agg(
        F.min(F.struct("distance", "position", "candidate")).alias("b")
    )
    return left.join(best.hint("merge"), "name", "left").select(
        "name", F.col("b.candidate").alias("candidate"), F.col("b.distance").cast("bigint").alias("distance")
    )


def _anchor_width(s: Column) -> Column:
    out = None
    for w in ANCHOR_WIDTHS:
        test = F.length(s) >= w
        out = F.when(test, w) if out is None else out.when(test, w)
    return out


def _pieces(s: Column, width: int) -> Column:
    """All substrings of one width."""
    places = F.sequence(F.lit(1), F.length(s) - (width - 1))
    cut = F.transform(places, lambda i: F.substring(s, i, F.lit(width)))
    return F.when(F.length(s) >= width, cut).otherwise(F.array().cast("array<string>"))


#: Characters of a literal that a place of a line must show first, and key lengths per such head up to which whole literals are keys.
HEAD, MOST_LENGTHS = 4, 16


def longest_literal(lines: DataFrame, literals: DataFrame, group: str) -> DataFrame:
    """Owner of the longest literal contained in each line (case-insensitive).

    ``lines(group, text)``, ``literals(group, owner, literal, position)``.
    Only places of a line that show the first ``HEAD`` characters of some literal give pieces, and only of lengths that
    literals with that head have as keys.  The key is the whole literal, or, where a head has more than ``MOST_LENGTHS``
    lengths, its leading 16/8/4/2/1 characters.  So a line meets the literals it contains, and few others.  Equal texts are
    matched once.  The earliest literal wins a tie.
    """
    texts = lines.select(group, "text").distinct()
    lit = stored(
        literals.where(F.length("literal") > 0)
        .withColumn("lit", F.lower("literal"))
        .groupBy(group, "lit")
        .agg(F.min(F.struct("position", "owner")).alias("o"), F.max(F.length("literal")).alias("len"))
        .select(group, "lit", "len", "o.position", "o.owner", F.substring("lit", 1, HEAD).alias("head")),
        "literals",
    )
    width, long = _anchor_width(F.col("lit")), F.length("lit")
    lengths = lit.groupBy("head").agg(F.collect_set(long).alias("whole"), F.collect_set(width).alias("some"))
    heads = stored(lengths.select("head", (F.size("whole") <= MOST_LENGTHS).alias("is_whole"), F.when(F.size("whole") <= MOST_LENGTHS, F.col("whole")).otherwise(F.col("some")).alias("sizes")), "heads")
    widths = [r[0] for r in heads.select(F.length("head")).distinct().collect()]  # at most HEAD of them
    most = heads.agg(F.max(F.array_max("sizes"))).first()[0] or 0
    low = F.lower("text")
    shown = lambda w: F.transform(
        F.when(F.length(low) >= w, F.sequence(F.lit(1), F.length(low) - (w - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.substring(low, i, F.lit(w)).alias("head"), F.substring(low, i, F.lit(most)).alias("tail")),
    )
    none = F.array().cast("array<struct<head:string,tail:string>>")
    places = texts.select(group, "text", F.inline(F.array_distinct(F.concat(none, *[shown(w) for w in widths]))))
    pieces = places.join(heads, "head").select(
        group, "text", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("tail")), lambda n: F.substring("tail", F.lit(1), n))).alias("key")
    )
    keyed = lit.join(heads, "head").select(group, "lit", "len", "position", "owner", F.when(F.col("is_whole"), F.col("lit")).otherwise(F.substring("lit", F.lit(1), width)).alias("key"))
    hits = pieces.join(keyed.hint("merge"), [group, "key"]).where(low.contains(F.col("lit")))
    best = hits.groupBy(group, "text").agg(
        F.max(F.struct(F.col("len"), (-F.col("position")).alias("neg"), F.col("owner"))).alias("b")
    )
    return texts.join(best.hint("merge"), [group, "text"], "left").select(
        group, "text", F.col("b.owner").alias("owner"), F.col("b.len").cast("bigint").alias("literal_len")
    )


#: Parts of a pattern that stand for varying text; a pattern made of these and of plain characters has fixed factors.
_VARYING = r"\\[sdwSDWbB][+*]?|\[[^\]\[\\^]+\][+*]?"
_PLAIN = r"[A-Za-z0-9_ =:;,/%#@&<>!~\"'-]"
#: Shares of the texts that meet rules without a fixed factor.
RULE_SALTS = 64
#: Rows of rules up to which they are broadcast.
BROADCAST_RULES = 50_000


def fixed_factor(pattern: Column) -> Column:
    """Longest text, in lower case, that every match of a pattern holds; null where the pattern is not plain enough to tell."""
    parts = F.split(F.regexp_replace(pattern, F.lit(_VARYING), F.lit("\x01")), "\x01")
    longest = F.aggregate(parts, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.when(pattern.rlike(f"^(?:{_PLAIN}|{_VARYING})+$"), F.lower(F.nullif(longest, F.lit(""))))


def first_rules(texts: DataFrame, rules: DataFrame, group: str, values: list[str]) -> DataFrame:
    """The first rule that applies to each text: columns ``values`` of the rule with the least ``place``, null if none applies.

    ``texts(group, text)``; ``rules(group, place, field, pattern, ...)``.  A rule applies where the text contains
    ``field`` or, if that is null, matches ``pattern``, both without regard to case; a rule with neither never applies.
    Places are unique in a group.  Each rule waits at one piece of its field, or of a text that all matches of its
    pattern hold: the piece that the fewest rules hold.  Each text visits its own pieces, so only rules that can apply meet it; the rules, once written,
    are broadcast up to ``BROADCAST_RULES`` rows and merged beyond.  Rules without such a text, as ``a|b``,
    meet every text, in ``RULE_SALTS`` shares.  Null texts have no rule; equal texts are judged once.
    """
    lit = F.lower(F.coalesce("field", fixed_factor(F.col("pattern"))))
    known = rules.where(F.col("field").isNotNull() | F.col("pattern").isNotNull()).select(
        group, "place", "field", "pattern", F.struct(*values).alias("_rule"), F.nullif(lit, F.lit("")).alias("_lit")
    )
    known = known.withColumn("_width", F.when(F.col("_lit").isNotNull(), _anchor_width(F.col("_lit"))))
    widths = sorted(r[0] for r in known.select("_width").distinct().collect() if r[0])  # at most all of ANCHOR_WIDTHS
    of_width = lambda s: F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.when(F.col("_width") == w, _pieces(s, w)).otherwise(F.array().cast("array<string>")) for w in widths]))
    pieces = known.where("_width IS NOT NULL").select("*", F.explode(of_width(F.col("_lit"))).alias("_anchor"))
    held = pieces.groupBy(group, "_anchor").agg(F.count("*").alias("_held"))
    keyed = pieces.join(held, [group, "_anchor"]).groupBy(group, "place").agg(
        F.min_by(F.struct("field", "pattern", "_rule", "_lit", "_anchor"), F.struct("_held", "_anchor")).alias("_r")
    ).select(group, "place", "_r.*")
    free = known.where("_width IS NULL").select(
        group, "place", "field", "pattern", "_rule", F.lit("").alias("_lit"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1)), lambda i: F.concat(F.lit("\x00"), i.cast("string")))).alias("_anchor"),
    )
    waiting = stored(keyed.unionByName(free), "rules")
    # Rules from the program have no size for the planner, which then broadcasts the pieces of the texts instead.
    waiting = F.broadcast(waiting) if waiting.count() <= BROADCAST_RULES else waiting.hint("merge")
    each = texts.select(group, "text").where(F.col("text").isNotNull()).distinct().withColumn("_low", F.lower("text"))
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("text"), F.lit(RULE_SALTS)).cast("string"))
    places = F.array_distinct(F.concat(F.array(salt), *[_pieces(F.col("_low"), w) for w in widths]))
    met = each.select(group, "text", "_low", F.explode(places).alias("_anchor")).join(waiting, [group, "_anchor"])
    met = met.where(
        F.col("_low").contains(F.col("_lit"))
        & F.when(F.col("field").isNotNull(), F.col("_low").contains(F.lower("field"))).otherwise(F.regexp_like("text", F.concat(F.lit("(?i)"), "pattern")))
    )
    best = met.groupBy(group, "text").agg(F.min_by("_rule", "place").alias("_rule"))
    return texts.select(group, "text").distinct().join(best.hint("merge"), [group, "text"], "left").select(group, "text", *[F.col(f"_rule.{v}").alias(v) for v in values])


def merge(target: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keyed upsert with a verdict per change.

    ``changes`` holds one row per key with ``op`` in I/U/D/S (S: insert if
    absent, else replace).  Returns every key once: its resulting row, whether
    it survives, and what happened.
    """
    t = target.select(F.col(key), F.lit(True).alias("_t"), *[F.col(v).alias(f"_t_{v}") for v in values])
    c = changes.select(F.col(key), F.col("op"), *[F.col(v).alias(f"_c_{v}") for v in values])
    j = t.join(c, key, "full")
    old, op = F.coalesce(F.col("_t"), F.lit(False)), F.col("op")
    verdict = (
        F.when(op.isNull(), "KEPT")
        .when((op == "I") & old, "REJECTED DUPLICATE")
        .when((op == "I") | ((op == "S") & ~old), "INSERTED")
        .when(~old, "REJECTED NOT FOUND")
        .when(op == "D", "DELETED")
        .otherwise("UPDATED")
    )
    j = j.withColumn("action", verdict)
    takes = F.col("action").isin("INSERTED", "UPDATED")
    return j.select(
        key,
        *[F.when(takes, F.col(f"_c_{v}")).otherwise(F.col(f"_t_{v}")).alias(v) for v in values],
        "action",
        (~F.col("action").isin("DELETED", "REJECTED NOT FOUND")).alias("live"),
    )
