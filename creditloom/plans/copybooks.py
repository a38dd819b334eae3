"""COPY statements of a source estate: found over lines, resolved by library, expanded.

Statements may go over several lines, share a line, or stand beside literals that go over lines; a finite-state scan
tells what is code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.text import replacing_pattern
from creditloom.operators.automata import states_before, token_map
from creditloom.operators.graph import reach, strong_components
from creditloom.operators.ordered import running_sum
from creditloom.session import cut, stored

# Nesting levels beyond which a book is marked, the library of a COPY that names none.
MAX_DEPTH = 10
DEFAULT_LIBRARY = "DEFAULT"

#: Lines of one statement at most; a longer one has lost its period and is reported instead.
STATEMENT_LINES = 500
CODE, SINGLE, DOUBLE, COPY, PSEUDO, COPY_SINGLE, COPY_DOUBLE = range(7)
IN_COPY = (COPY, PSEUDO, COPY_SINGLE, COPY_DOUBLE)
KEEP, END, AGAIN_SINGLE, AGAIN_DOUBLE = "keep", "end", "again'", 'again"'
CLASSES = ["'", '"', "==", "COPY", ".", END, AGAIN_SINGLE, AGAIN_DOUBLE]
#: State after each kind of token, by state: literals hide everything but their own quote, pseudo-text all but its end.
#: The last three stand at the beginning of a line: it ends open literals, or opens one again by the quote that follows.
NEXT = [
    [SINGLE, CODE, DOUBLE, COPY_SINGLE, PSEUDO, COPY, COPY_DOUBLE],
    [DOUBLE, SINGLE, CODE, COPY_DOUBLE, PSEUDO, COPY_SINGLE, COPY],
    [CODE, SINGLE, DOUBLE, PSEUDO, COPY, COPY_SINGLE, COPY_DOUBLE],
    [COPY, SINGLE, DOUBLE, COPY, PSEUDO, COPY_SINGLE, COPY_DOUBLE],
    [CODE, SINGLE, DOUBLE, CODE, PSEUDO, COPY_SINGLE, COPY_DOUBLE],
    [CODE, CODE, CODE, COPY, PSEUDO, COPY, COPY],
    [CODE, CODE, DOUBLE, COPY, PSEUDO, COPY, COPY_DOUBLE],
    [CODE, SINGLE, CODE, COPY, PSEUDO, COPY_SINGLE, COPY],
]
STATES = len(NEXT[0])
WORD = r"(?<![A-Za-z0-9#@$-])[Cc][Oo][Pp][Yy](?=\s|$)"
TOKEN = rf"'|\"|==|{WORD}|\.(?=\s|$)"
MARK = "\x01"
_CLAUSE = r"(?:[^.=\x01]++|==(?:[^=]++|=(?!=))*+==|=|\.(?!\s|$))*+"
STATEMENT = rf"(?i)COPY{MARK}(\d+){MARK}\s+([A-Z0-9#@$-]+)(?:\s+(?:IN|OF)\s+([A-Z0-9-]+))?(?:\s+REPLACING\s+({_CLAUSE}))?\s*\.(?=\s|$)"
ONE_LITERAL = r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)"


def code_of(text: Column) -> Column:
    """The code of a raw line: columns 8 to 72 where the line looks like a card, else all of it."""
    cards = (F.length(text) >= 7) & F.substring(text, 7, 1).isin(" ", "-", "D", "d") & (
        F.substring(text, 1, 6).rlike(r"^[ 0-9]{6}$") | (F.substring(text, 8, 4) == "    ")
    )
    return F.when(cards, F.rtrim(F.substring(text, 8, 65))).otherwise(F.rtrim(text))


def _after(tokens: list[str], state: int) -> int:
    """The state behind some tokens."""
    for t in tokens:
        state = NEXT[CLASSES.index(t)][state]
    return state


def is_comment(text: Column) -> Column:
    return F.substring(text, 7, 1).isin("*", "/")


def _tokenized(lines: DataFrame) -> DataFrame:
    """Lines with their code, its tokens, and how the line begins (``_start``); comments have no tokens."""
    comment, marked = is_comment(F.col("text")), F.substring("text", 7, 1) == "-"
    coded = lines.withColumn("_code", code_of(F.col("text")))
    # A literal goes on only where the next line is marked as its continuation; there a quote in front opens it again.
    first = F.substring(F.ltrim("_code"), 1, 1)
    begin = F.when(comment, F.lit(KEEP)).when(~marked, F.lit(END)).when(first == "'", F.lit(AGAIN_SINGLE)).when(first == '"', F.lit(AGAIN_DOUBLE)).otherwise(F.lit(KEEP))
    found = F.when(comment, F.array().cast("array<string>")).otherwise(F.transform(F.regexp_extract_all("_code", F.lit(TOKEN), F.lit(0)), F.upper))
    return coded.withColumns({"_tokens": found, "_start": begin})


def _walk(state: Column) -> Column:
    """From ``state`` through the tokens of a line: the state behind it (``now``) and whether a COPY began (``hit``)."""
    flat, names = F.array(*[F.lit(x) for row in NEXT for x in row]), F.array(*[F.lit(c) for c in CLASSES])
    return F.aggregate(
        F.filter(F.transform("_tokens", lambda t: F.array_position(names, t)), lambda c: c > 0),
        F.struct(state.alias("now"), F.lit(False).alias("hit")),
        lambda acc, c: F.struct(
            F.element_at(flat, ((c - 1) * STATES + acc["now"] + 1).cast("int")).alias("now"), (acc["hit"] | ((acc["now"] == CODE) & (c == CLASSES.index("COPY") + 1))).alias("hit")
        ),
    )


def _scanned(lines: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Tokenized lines with the state before each (``_before``)."""
    plain = F.col("_start") == END
    constant = lambda names: F.array(*[F.lit(_after(names, x)) for x in range(STATES)])
    tokens = F.col("_tokens")
    # Most lines hold no token, or the period that ends them.
    move = (
        F.when(plain & (F.size(tokens) == 0), constant([END])).when(plain & (F.size(tokens) == 1) & (tokens[0] == "."), constant([END, "."]))
        .otherwise(token_map(F.concat(F.array("_start"), tokens), CLASSES, NEXT))
    )
    seen = states_before(lines, keys, pos, move, STATES, CODE, "_before")
    resume = lambda name: F.element_at(constant([name]), F.col("_before") + 1)
    return seen.withColumn(
        "_before", F.when(plain, resume(END)).when(F.col("_start") == AGAIN_SINGLE, resume(AGAIN_SINGLE)).when(F.col("_start") == AGAIN_DOUBLE, resume(AGAIN_DOUBLE)).otherwise(F.col("_before"))
    )


def _marked(code: Column, before: Column, number: Column) -> Column:
    """Code in which each COPY outside literals carries the number of its line."""
    quote = F.when(before.isin(SINGLE, COPY_SINGLE), "'").when(before.isin(DOUBLE, COPY_DOUBLE), '"')
    at = F.position(quote, code)
    cutoff = F.when(quote.isNull(), F.lit(0)).when(at > 0, at).otherwise(F.length(code))
    head, rest = F.substr(code, F.lit(1), cutoff), F.substr(code, cutoff + 1)
    # Literals and COPY words both leave a mark; the one behind a literal is taken off again.
    both = F.regexp_replace(rest, F.lit(rf"({ONE_LITERAL})|{WORD}"), F.lit(f"$1{MARK}"))
    only = F.regexp_replace(both, F.lit(rf"({ONE_LITERAL}){MARK}"), F.lit("$1"))
    return F.concat(head, F.replace(only, F.lit(MARK), F.concat(F.lit(f"COPY{MARK}"), number.cast("string"), F.lit(MARK))))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, rf"{MARK}\d+{MARK}", "")


def _joined(numbered: DataFrame, keys: list[str], pos: str) -> tuple[DataFrame, DataFrame]:
    """Stretches of numbered lines with their code in one string, and the lines of those that hold a whole statement."""
    sizes = cut(numbered.groupBy(*keys, "_run").agg(F.count("*").alias("_lines"), F.min(pos).alias("first"), F.max(pos).alias("last")))
    short = numbered.join(sizes.where(F.col("_lines") <= STATEMENT_LINES).select(*keys, "_run"), [*keys, "_run"])
    code = _marked(F.col("_code"), F.col("_before"), F.col(pos))
    texts = short.groupBy(*keys, "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), code.alias("c")))), lambda s: s["c"]), " ").alias("joined")
    )
    runs = cut(sizes.join(texts, [*keys, "_run"], "left").select(*keys, "_run", "first", "last", F.concat("joined", F.lit(" ")).alias("joined")))
    ended = runs.where(F.regexp_like("joined", F.lit(STATEMENT))).select(*keys, "_run")
    return runs.drop("_run"), numbered.join(ended, [*keys, "_run"]).select(*keys, pos)


def copy_runs(lines: DataFrame, keys: list[str] = ["file"], pos: str = "line_no") -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Stretches of lines that hold COPY statements, and all other lines.

    The first has ``keys``, ``first`` and ``last`` position and ``joined``, the code of the lines with each COPY
    numbered (null where it is longer than ``STATEMENT_LINES`` lines); the second is ``lines`` without those of stretches that
    hold a whole statement.  Comment lines inside a statement stay among the others.  Only files in which some line
    leaves a literal or statement open, or continues one, are scanned; in all others each line stands for itself.
    """
    text = F.col("text")
    some = F.upper(text).contains("COPY") | text.contains("'") | text.contains('"') | (F.substring(text, 7, 1) == "-")
    told = _tokenized(lines.where(some & ~is_comment(text))).withColumn("_end", _walk(F.lit(CODE)))
    wild = cut(told.where((F.col("_end.now") != CODE) | (F.col("_start") != END)).select(*keys).distinct())
    flat = told.where(F.array_contains("_tokens", "COPY") & F.col("_end.hit")).join(wild, keys, "left_anti")
    own = _marked(F.col("_code"), F.lit(CODE), F.col(pos))
    runs = cut(flat.select(*keys, F.col(pos).alias("first"), F.col(pos).alias("last"), F.concat(own, F.lit(" ")).alias("joined")))
    taken = runs.where(F.regexp_like("joined", F.lit(STATEMENT))).select(*keys, F.col("first").alias(pos))
    if not wild.isEmpty():
        scanned = cut(_scanned(cut(_tokenized(lines.join(wild, keys, "left_semi"))), keys, pos))
        inside = F.col("_before").isin(*IN_COPY)
        begins = F.array_contains("_tokens", "COPY") & _walk(F.col("_before"))["hit"]
        here = scanned.where(~is_comment(text) & (inside | begins)).select(*keys, pos, "_code", "_before")
        numbered = running_sum(here.withColumn("_first", (~inside).cast("bigint")), keys, pos, "_run", F.col("_first"))
        more, used = _joined(cut(numbered.drop("_first")), keys, pos)
        runs, taken = runs.unionByName(more), taken.unionByName(used)
    return runs, lines.join(taken, [*keys, pos], "left_anti")


def _statements(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per COPY statement in order (``nth`` from 1 inside its stretch, ``alone`` if the stretch holds nothing else)."""
    alone = F.trim(F.regexp_replace("joined", STATEMENT, "")) == ""
    every = F.regexp_extract_all("joined", F.lit(STATEMENT), F.lit(0))
    found = runs.where(F.col("joined").isNotNull()).select(*keys, "first", (alone & (F.size(every) == 1)).alias("alone"), F.posexplode(every).alias("p", "_s"))
    group = lambda i: F.nullif(F.regexp_extract("_s", STATEMENT, i), F.lit(""))
    return found.select(
        *keys, "first", "alone", (F.col("p") + 1).alias("nth"), F.regexp_extract("_s", STATEMENT, 1).cast("bigint").alias("line_no"), F.upper(group(2)).alias("copybook"),
        F.upper(F.coalesce(group(3), F.lit(DEFAULT_LIBRARY))).alias("library"), F.trim(F.regexp_replace(_bare(F.coalesce(group(4), F.lit(""))), r"\s+", " ")).alias("replacing"),
    )


def copy_statements(lines: DataFrame) -> DataFrame:
    """COPY statements wherever they stand: (file, line_no of the word COPY, copybook, library, replacing)."""
    return _statements(copy_runs(lines)[0], ["file"]).select("file", "line_no", "copybook", "library", "replacing")


def unended_copies(lines: DataFrame) -> DataFrame:
    """Places where a COPY is not ended by a period, so that it gives no edge: (file, line_no)."""
    runs = cut(copy_runs(lines)[0])
    left = F.regexp_extract_all(F.regexp_replace("joined", STATEMENT, " "), F.lit(rf"COPY{MARK}(\d+){MARK}"), F.lit(1))
    open_ = runs.where(F.col("joined").isNotNull()).select("file", F.explode(left).alias("n")).select("file", F.col("n").cast("bigint").alias("line_no"))
    return open_.unionByName(runs.where(F.col("joined").isNull()).select("file", F.col("first").alias("line_no")))


def pairs_of(clause: Column) -> Column:
    """Array of (old, new) from ``==old== BY ==new==`` pairs."""
    p = r"(?i)==([^=]+)==\s+BY\s+==([^=]+)=="
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(clause, F.lit(p), F.lit(1)), F.trim).alias("old"), F.transform(F.regexp_extract_all(clause, F.lit(p), F.lit(2)), F.trim).alias("new")
    )


def _named(books: DataFrame) -> DataFrame:
    """Book lines with upper-case ``file`` and ``library``; books without a library are in the default one."""
    library = F.coalesce(F.upper("library"), F.lit(DEFAULT_LIBRARY)) if "library" in books.columns else F.lit(DEFAULT_LIBRARY)
    return books.select(library.alias("library"), F.upper("file").alias("file"), F.col("line_no").cast("bigint").alias("line_no"), "text")


def _key(library: Column, name: Column) -> Column:
    return F.concat(library, F.lit("/"), name)


def book_statements(books: DataFrame) -> DataFrame:
    """COPY statements inside books: (book, line_no, copybook, library, replacing); ``book`` is library/name."""
    named = _named(books).withColumn("book", _key(F.col("library"), F.col("file"))).select("book", "line_no", "text")
    return _statements(copy_runs(named, ["book"])[0], ["book"]).select("book", "line_no", "copybook", "library", "replacing")


def rings_of(inner: DataFrame) -> DataFrame:
    """Books that reach themselves: (book, ring), the ring named by its least book."""
    edges = inner.select(F.col("book").alias("src"), _key(F.col("library"), F.col("copybook")).alias("dst"))
    found = strong_components(edges)
    many = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("component")
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node")).distinct()
    ringed = found.join(many, "component").select("node", "component")
    return ringed.unionByName(loops.join(ringed, "node", "left_anti").select("node", F.col("node").alias("component"))).select(F.col("node").alias("book"), F.col("component").alias("ring"))


def closure(programs: DataFrame, books: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Books each program needs: (file, library, copybook, depth, status, ring).

    Only books below the books that programs name are followed.  Status is circular (the book is on a ring, named by
    ``ring``), unresolved (no such book in that library), too_deep (over ``max_depth`` levels) or resolved.
    """
    inner = cut(book_statements(books))
    direct = cut(copy_statements(programs).select("file", _key(F.col("library"), F.col("copybook")).alias("node")).distinct())
    edges = inner.select(F.col("book").alias("src"), _key(F.col("library"), F.col("copybook")).alias("dst")).distinct()
    below = reach(edges, direct.select("node").distinct())
    every = direct.select("file", "node", F.lit(1).cast("bigint").alias("depth")).unionByName(
        direct.join(below.withColumnRenamed("source", "_top").withColumnRenamed("node", "_low"), F.col("node") == F.col("_top")).select("file", F.col("_low").alias("node"), (F.col("distance") + 1).alias("depth"))
    )
    least = every.groupBy("file", "node").agg(F.min("depth").alias("depth"))
    known = _named(books).select(_key(F.col("library"), F.col("file")).alias("node")).distinct().withColumn("_known", F.lit(True))
    rings = rings_of(inner).withColumnRenamed("book", "node")
    j = least.join(known, "node", "left").join(rings, "node", "left")
    status = F.when(F.col("_known").isNull(), "unresolved").when(F.col("ring").isNotNull(), "circular").when(F.col("depth") > max_depth, "too_deep").otherwise("resolved")
    part = lambda i: F.split_part("node", F.lit("/"), F.lit(i))
    return j.select("file", part(1).alias("library"), part(2).alias("copybook"), "depth", status.alias("status"), "ring")


def _slot(c: Column) -> Column:
    """Sorts like the number: nine digits, longer numbers behind a letter for their length."""
    digits = c.cast("string")
    return F.when(F.length(digits) <= 9, F.lpad(digits, 9, "0")).otherwise(F.concat(F.char(F.length(digits) + 55), digits))


def expand(lines: DataFrame, books: DataFrame, marks: bool = True) -> DataFrame:
    """Source with COPY statements replaced by the books' lines: (file, place, text).

    ``place`` sorts as text into reading order.  Code before, between and behind the statements of a stretch stays, as
    lines of its own.  With ``marks``, comment lines stand around every book.  A missing book leaves a comment.  From the
    statement that enters a ring of books, each of its books is run through once; a further statement for one of them
    leaves a comment, so mutual copies do not multiply.  Replacements apply to the book's lines before its own statements are read.
    One round per nesting level, all files at once.
    """
    body = cut(_named(books).withColumn("book", _key(F.col("library"), F.col("file"))).select("book", "line_no", "text"))
    names = cut(body.select("book").distinct().withColumn("_known", F.lit(True)))
    rings = cut(rings_of(book_statements(books)).withColumnRenamed("ring", "_ring"))
    keys = ["file", "stem"]
    # ``stem`` is the place of the statement that brought the lines in; ``entry`` the place where their ring was entered.
    front = lines.select("file", F.lit("").alias("stem"), F.col("line_no").cast("bigint").alias("line_no"), "text")
    none = F.lit(None).cast("string")
    above = lines.select("file").distinct().select("file", F.lit("").alias("stem"), none.alias("ring"), none.alias("entry"))
    visited = lines.sparkSession.createDataFrame([], "file string, entry string, book string")
    done = None
    while True:
        front = stored(front, "copy-lines")
        at = lambda n: F.concat(F.when(F.col("stem") == "", "").otherwise(F.concat("stem", F.lit("."))), _slot(n))
        add = lambda df: df if done is None else done.unionByName(df)  # noqa: E731, B023
        runs, rest = copy_runs(front, keys)
        done = add(rest.select("file", at(F.col("line_no")).alias("place"), "text"))
        pieces = runs.where(F.regexp_like("joined", F.lit(STATEMENT))).select(*keys, "first", F.posexplode(F.split("joined", STATEMENT)).alias("nth", "_t"))
        pieces = pieces.withColumn("_t", F.trim(_bare(F.col("_t")))).where(F.col("_t") != "")
        done = add(pieces.select("file", F.concat(at(F.col("first")), F.lit("."), _slot(2 * F.col("nth"))).alias("place"), F.concat(F.lit("           "), "_t").alias("text")))
        calls = _statements(runs, keys).withColumn("book", _key(F.col("library"), F.col("copybook")))
        inner_place = F.concat(at(F.col("first")), F.lit("."), _slot(2 * F.col("nth") - 1))
        calls = calls.withColumn("place", F.when(F.col("alone"), at(F.col("first"))).otherwise(inner_place))
        calls = calls.join(above, keys).join(rings, "book", "left").join(names, "book", "left")
        here = F.coalesce(F.col("_ring") == F.col("ring"), F.lit(False))
        calls = calls.withColumn("entry", F.when(here, F.col("entry")).when(F.col("_ring").isNotNull(), F.col("place")))
        seen = visited.withColumn("_seen", F.lit(True))
        calls = calls.withColumn("_here", here).join(seen, ["file", "entry", "book"], "left")
        # Of several calls of one book at this level inside a ring, the first goes on.
        first = calls.where(F.col("_here") & F.col("_seen").isNull()).groupBy("file", "entry", "book").agg(F.min("place").alias("_least"))
        calls = stored(calls.join(first, ["file", "entry", "book"], "left"), "copy-calls")
        if calls.isEmpty():
            return done
        again = F.col("_here") & (F.coalesce("_seen", F.lit(False)) | (F.col("place") != F.coalesce("_least", "place")))
        lost = ~again & F.col("_known").isNull()
        go = calls.where(~again & F.col("_known").isNotNull())
        line = lambda df, mark, text: df.select("file", F.concat("place", F.lit(mark)).alias("place"), F.concat(*text).alias("text"))
        for rows, word in ((calls.where(again), "CIRCULAR"), (calls.where(lost), "UNRESOLVED")):
            done = add(line(rows, "", [F.lit(f"      * >>>{word} COPY: "), F.col("copybook"), F.lit("<<<")]))
        if marks:
            done = add(line(go, ".", [F.lit("      * >>>BEGIN COPY "), F.col("copybook"), F.lit(" FROM "), F.col("book"), F.lit("<<<")]))
            done = add(line(go, ".~", [F.lit("      * >>>END COPY "), F.col("copybook"), F.lit("<<<")]))
        visited = cut(visited.unionByName(go.where(F.col("entry").isNotNull()).select("file", "entry", "book")))
        above = go.select("file", F.col("place").alias("stem"), F.col("_ring").alias("ring"), "entry")
        inner = go.select("file", F.col("place").alias("stem"), "book", pairs_of(F.col("replacing")).alias("_pairs")).join(body, "book")
        replaced = F.aggregate("_pairs", F.col("text"), lambda acc, p: F.regexp_replace(acc, replacing_pattern(p["old"]), p["new"]))
        front = inner.select("file", "stem", "line_no", replaced.alias("text"))
