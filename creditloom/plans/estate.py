"""Code-estate inventory over source lines (file, line_no, text).

Everything works line by line: regular expressions for what a line says,
running values for where it stands.  No statement trees are built; COPY
statements, which go over lines, are in ``copybooks``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import idiv
from creditloom.functions.text import condition_threshold
from creditloom.operators.ordered import fill_forward, running, running_sum
from creditloom.plans.copybooks import copy_statements
from creditloom.session import cut

# Words that cannot name a paragraph.
RESERVED = """
ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE ELSE END EVALUATE EXEC EXIT GO GOTO GOBACK IF
INITIALIZE INSPECT MERGE MOVE MULTIPLY NEXT OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STOP-RUN
STRING SUBTRACT UNSTRING WRITE
END-CALL END-COMPUTE END-DELETE END-EVALUATE END-IF END-PERFORM END-READ END-REWRITE END-STRING END-UNSTRING END-WRITE
SECTION DIVISION WORKING-STORAGE PROCEDURE DATA ENVIRONMENT IDENTIFICATION LINKAGE FILE LOCAL-STORAGE SCREEN REPORT
COMMUNICATION
PROGRAM-ID AUTHOR DATE-WRITTEN INSTALLATION DATE-COMPILED SECURITY
OBJECT-COMPUTER SOURCE-COMPUTER SPECIAL-NAMES FILE-CONTROL I-O-CONTROL
SELECT ASSIGN ORGANIZATION ACCESS RECORD KEY STATUS FD SD RD CD
WHEN THEN NOT AND OR ALSO OTHER TRUE FALSE THRU THROUGH
USING GIVING RETURNING INTO FROM TO BY UNTIL VARYING AFTER BEFORE UPON WITH CORRESPONDING CORR ROUNDED REMAINDER
ON SIZE ERROR OVERFLOW AT END-OF-PAGE INVALID ASCENDING DESCENDING
""".split()
# Statement verbs, and words allowed to look like a reserved paragraph.
VERBS = """
DISPLAY MOVE ACCEPT PERFORM IF EVALUATE READ WRITE REWRITE DELETE CALL ADD SUBTRACT MULTIPLY DIVIDE COMPUTE GO GOTO OPEN
CLOSE STOP EXEC STRING UNSTRING SEARCH SET INSPECT SORT INITIALIZE RETURN RELEASE EXIT GOBACK CONTINUE WHEN
""".split()
QUIET_RESERVED = """
STOP-RUN EXIT GOBACK CONTINUE END-READ END-WRITE END-REWRITE END-DELETE END-PERFORM END-IF END-EVALUATE END-COMPUTE
END-STRING END-UNSTRING END-CALL
""".split()
ARITHMETIC = ["COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"]
VARIABLE_LIKE = ("WS-", "ACCT-", "EMP-")
NAME = r"[A-Z0-9][A-Z0-9-]*"
#: What a regular expression takes for blank.
BLANKS = " \t\n\x0b\f\r"
MAX_SLICE = 4
WHOLE_LINES, SECTION_LINES, BLOCK_LINES, OVERLAP_LINES = 600, 1500, 120, 10
# Texts that mark a chunk as usable.
USABLE_MARKERS = (
    "IF ", "EVALUATE", "COMPUTE", "CALL ", "MOVE ", "PERFORM", "READ", "WRITE", "OPEN", "CLOSE", "INSPECT", "STRING", "UNSTRING", "SORT", "MERGE", "PIC ", "OCCURS ",
)


def _hit(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _begins(c: Column, *words: str) -> Column:
    """Whether a text begins with one of some words."""
    return reduce(or_, [c.startswith(w) for w in words])


# --- lines -------------------------------------------------------------------

def classify_format(lines: DataFrame) -> DataFrame:
    """'fixed' when at least a third of the non-blank lines start with six digits or blanks."""
    t = F.regexp_replace("text", r"[\r\n]+$", "")
    body = lines.select("file", t.alias("t"), (F.trim(t) != "").alias("full"))
    agg = body.groupBy("file").agg(
        F.count_if(F.col("full")).alias("n"),
        F.count_if(F.col("full") & (F.length("t") >= 7) & F.col("t").rlike("^[ 0-9]{6}")).alias("k"),
    )
    fixed = (F.col("n") == 0) | (F.col("k") >= F.greatest(F.lit(1), idiv(F.col("n"), 3)))
    return agg.select("file", F.col("n").alias("lines"), F.col("k").alias("fixed_like"), F.when(fixed, "fixed").otherwise("free").alias("format"))


def code_lines(lines: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Code without comments: columns 8-72 of fixed lines, blanks squeezed.

    Without ``formats`` every file is taken as fixed.
    """
    src = lines if formats is None else lines.join(formats.select("file", "format"), "file")
    fixed = F.lit(True) if formats is None else F.col("format") == "fixed"
    raw = F.col("text")
    mark = F.when(fixed, F.substring(raw, 7, 1)).otherwise("")
    body = F.when(fixed, F.substring(raw, 8, 65)).otherwise(raw)
    squeezed = F.trim(F.regexp_replace(body, r"\s+", " "))
    out = src.select(
        "file", "line_no", mark.alias("indicator"), squeezed.alias("code"), F.upper(squeezed).alias("upper"),
        (~fixed | (F.length(body) - F.length(F.ltrim(body)) <= 3)).alias("area_a"),
        (fixed & (F.trim(F.substring(raw, 73, 8)) != "")).alias("beyond_72"),
        (F.when(fixed, F.substring(raw, 7, 1).isin("*", "/")).otherwise(F.ltrim(raw).startswith("*"))).alias("_comment"), body.alias("_body"),
    )
    # As code <> '', but read off the raw line: the filter runs below, and would squeeze each line a second time.
    return out.where(~F.col("_comment") & (F.btrim(F.col("_body"), F.lit(BLANKS)) != "")).drop("_comment", "_body")


def join_continuations(lines: DataFrame, is_continuation: Column, tail: Column, keys: list[str]) -> DataFrame:
    """Append continuation lines to the line they continue: (keys, line_no, text)."""
    flagged = lines.withColumns({"_start": (~is_continuation).cast("bigint"), "_piece": F.when(is_continuation, tail).otherwise(F.rtrim("text"))})
    grouped = running_sum(flagged, keys, "line_no", "_stmt", F.col("_start"))
    return grouped.groupBy(*keys, "_stmt").agg(
        F.min("line_no").alias("line_no"), F.expr("listagg(_piece, ' ') within group (order by line_no)").alias("text")
    ).drop("_stmt")


def logical_source(lines: DataFrame) -> DataFrame:
    """Source lines with hyphen continuations joined."""
    return join_continuations(lines, F.substring("text", 7, 1) == "-", F.ltrim(F.expr("substring(text, 8)")), ["file"])


def _header_like(allow_reserved: bool = False) -> Column:
    token = F.regexp_replace("upper", r"\.$", "")
    ok = F.col("area_a") & (F.col("indicator") != "-") & F.col("upper").rlike(rf"^{NAME}\.$")
    return ok if allow_reserved else ok & ~token.isin(*RESERVED, *QUIET_RESERVED)


def with_context(code: DataFrame) -> DataFrame:
    """Division and paragraph of every code line, and the state of the condition stack.

    Adds division, paragraph, para_line, first values of ``seg`` (stretch
    between points where the stack is emptied) and ``bal`` (pushes minus pops).
    """
    up = F.col("upper")
    # Marks first, each pattern once per line; the running values only read them.
    marked = code.select(
        "*", F.when(up.contains("DIVISION") & up.rlike(r"^(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"), F.split(up, " ")[0]).alias("_dv"),
        F.when(_header_like(), F.regexp_replace(F.col("code"), r"\.$", "")).alias("_hd"),
        F.when((up.startswith("IF") | up.startswith("WHEN")) & up.rlike(r"^(IF|WHEN)\s+\S"), 1).otherwise(0).alias("_push"), F.when(up.contains("END-IF"), 1).otherwise(0).alias("_pop"),
        up.contains("END-EVALUATE").alias("_end"),
    )
    div, head = F.col("_dv").isNotNull(), F.col("_hd").isNotNull()
    clears = div | head | F.col("_end")
    out = running(
        marked, ["file"], "line_no",
        {
            "division": ("last", F.col("_dv")),
            "_div_line": ("last", F.when(div, F.col("line_no"))),
            "_para": ("last", F.col("_hd")),
            "_para_line": ("last", F.when(head, F.col("line_no"))),
            "seg": ("sum", F.when(clears, 1).otherwise(0).cast("bigint")),
            "bal": ("sum", F.when(clears, 0).otherwise(F.col("_push") - F.col("_pop")).cast("bigint")),
        },
        look=True,
    )
    inside = (F.col("division") == "PROCEDURE") & (F.col("_para_line") > F.col("_div_line"))
    return out.select(
        *code.columns, "division", F.when(inside, F.col("_para")).alias("paragraph"),
        F.when(inside, F.col("_para_line")).alias("para_line"), "seg", "bal",
    )


def procedure_lines(ctx: DataFrame) -> DataFrame:
    """Statement lines of the procedure division."""
    up = F.col("upper")
    named = (up.contains("DIVISION") | up.contains("SECTION")) & up.rlike(r"(DIVISION|SECTION)\.$|^PROCEDURE DIVISION")
    here = (F.col("division") == "PROCEDURE") & ~named
    return ctx.where(here & ~F.coalesce(F.col("para_line") == F.col("line_no"), F.lit(False)))


def paragraphs(ctx: DataFrame) -> DataFrame:
    """Paragraph headers in order: (file, paragraph, line_no)."""
    return ctx.where(F.col("para_line") == F.col("line_no")).select("file", "paragraph", "line_no")


def owner_paragraph(ctx: DataFrame) -> DataFrame:
    """Every code line with the paragraph above it."""
    return ctx.select("file", "line_no", "paragraph")


# --- data division -----------------------------------------------------------

ITEM = r"^(\d{2})\s+([A-Z0-9-]+)(.*?)\.?$"
OCCURS = r"\bOCCURS\s+(\d+)\s+TIMES(?:\s+INDEXED\s+BY\s+([A-Z][A-Z0-9-]*(?:\s+[A-Z][A-Z0-9-]*)*))?"


def data_items(ctx: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Level, name, clauses, kind and parent of every data item.

    The parent is the nearest item above with a lower level.  One running
    maximum per level gives its line, so items are never compared pairwise.
    Levels are two digits: when not given, the few in use are looked up, so
    callers that use ``ctx`` more than once should materialize it.
    """
    if levels is None:
        found = ctx.where((F.col("division") == "DATA") & F.col("upper").rlike(ITEM)).select(
            F.regexp_extract("upper", ITEM, 1).cast("bigint").alias("level")
        )
        levels = sorted(r[0] for r in found.distinct().collect() if 1 <= r[0] <= 49)
    up = F.col("upper")
    raw = ctx.where((F.col("division") == "DATA") & up.rlike(ITEM)).select(
        "file", "line_no", F.regexp_extract(up, ITEM, 1).cast("bigint").alias("level"), F.regexp_extract(up, ITEM, 2).alias("name"),
        F.trim(F.regexp_extract(up, ITEM, 3)).alias("rest"),
    )
    rest = F.col("rest")
    items = raw.select(
        "file", "line_no", "level", "name", _hit(rest, r"\bPIC(?:TURE)?\s+([A-Z0-9\(\)SVXAN\-\+Z,.]*[A-Z0-9\)])").alias("pic"),
        _hit(rest, r"\b(?:USAGE\s+IS\s+)?(COMP-3|COMP-1|COMP-2|COMP|DISPLAY|BINARY|PACKED-DECIMAL)\b").alias("usage"),
        F.trim(_hit(rest, r"\bVALUES?\s+(.+?)(?=\b(?:PIC|REDEFINES|USAGE|OCCURS|SYNC|SIGN)\b|$)")).alias("value"),
        _hit(rest, OCCURS).cast("bigint").alias("occurs"), _hit(rest, OCCURS, 2).alias("indexed_by"),
        _hit(rest, r"\bREDEFINES\s+([A-Z0-9-]+)\b").alias("redefines"),
    )
    level = F.col("level")
    seen = items if not levels else running(items, ["file"], "line_no", {f"_l{n}": ("max", F.when(level == n, F.col("line_no"))) for n in levels}, look=True)
    places = [F.when(level > n, F.col(f"_l{n}")) for n in levels]
    above = F.greatest(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("bigint")
    seen = seen.select(*items.columns, above.alias("parent_line"))
    up_names = items.select("file", F.col("line_no").alias("parent_line"), F.col("name").alias("parent"))
    pic = F.col("pic")
    kind = (
        F.when(level == 88, "condition").when(F.col("redefines").isNotNull(), "redefines").when(F.col("occurs").isNotNull(), "array")
        .when(pic.isNull(), "group").when(pic.rlike("[XA]"), "string").when(pic.contains("9"), "numeric").otherwise("unknown")
    )
    return seen.join(up_names, ["file", "parent_line"], "left").select(*items.columns, "parent", kind.alias("kind"))


def _digit_count(s: Column, ch: str) -> Column:
    """Positions of one picture character, repeats expanded."""
    spans = F.regexp_extract_all(s, F.lit(ch + r"\((\d+)\)"), F.lit(1))
    repeated = F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))
    single = F.regexp_replace(s, ch + r"\(\d+\)", "")
    return repeated + F.regexp_count(single, F.lit(ch)).cast("bigint")


def decode_pic(pic: Column) -> dict[str, Column]:
    """Type, digits, scale, sign and length of a picture."""
    p = F.upper(F.trim(pic))
    only_v = p.startswith("V")
    text = p.rlike("^[XA]")
    shown = p.startswith("Z")
    numeric = p.rlike("[S9]")
    whole, frac = F.split_part(p, F.lit("V"), F.lit(1)), F.split_part(p, F.lit("V"), F.lit(2))
    dec = F.when(numeric | shown, _digit_count(frac, "9")).otherwise(0)
    dec = F.when(~text, dec).otherwise(0)
    ints = F.when((numeric & ~text) | shown, _digit_count(whole, "9")).otherwise(0) + F.when(shown, _digit_count(p, "Z")).otherwise(0)
    v_dec = F.greatest(_digit_count(p, "9"), F.lit(1))
    one = F.regexp_extract(p, r"[XA]\((\d+)\)", 1)
    letters = F.regexp_count(p, F.lit("[XA]")).cast("bigint")
    kind = (
        F.when(only_v, "decimal").when(text, "text").when(shown, "edited").when(numeric & p.contains("V"), "decimal")
        .when(numeric, "integer").otherwise("text")
    )
    length = F.when(only_v, v_dec).when(text, F.when(one != "", one.cast("bigint")).otherwise(letters)).otherwise(ints + dec)
    return {
        "pic_type": kind,
        "int_digits": F.when(only_v, 0).otherwise(ints).cast("bigint"),
        "dec_digits": F.when(only_v, v_dec).otherwise(dec).cast("bigint"),
        "signed": p.startswith("S"),
        "implied_point": p.contains("V"),
        "storage_len": length.cast("bigint"),
    }


def decode_pics(items: DataFrame) -> DataFrame:
    """Decoded picture of every item that has one."""
    return items.where(F.col("pic").isNotNull()).select("file", "line_no", "name", "pic", *[c.alias(n) for n, c in decode_pic(F.col("pic")).items()])


def display_width(pic: Column) -> Column:
    """Characters of a DISPLAY item: 9, X, Z, A positions plus printed edit characters."""
    p = F.upper(F.trim(pic))
    n = _digit_count(p, "[9XZA]")
    return (n + F.regexp_count(p, F.lit(r"[.,+\-$*/]")).cast("bigint")).cast("bigint")


def layout_from_copybook(items: DataFrame) -> DataFrame:
    """Field offsets and lengths of each 01 record, from its pictures."""
    rec = fill_forward(items, ["file"], "line_no", {"record": F.when(F.col("level") == 1, F.col("name"))})
    leaf = rec.where((F.col("level") != 1) & (F.col("level") != 88) & F.col("pic").isNotNull()).withColumn("length", display_width(F.col("pic")))
    run = running_sum(leaf, ["file", "record"], "line_no", "_end", F.col("length"))
    return run.select("file", "record", "line_no", "name", (F.col("_end") - F.col("length")).alias("offset"), "length", "pic")


def condition_values(ctx: DataFrame, items: DataFrame) -> DataFrame:
    """88-level names with their values and the item they qualify."""
    owner = fill_forward(items, ["file"], "line_no", {"owner": F.when(~F.col("level").isin(66, 77, 88), F.col("name"))})
    c = owner.where(F.col("level") == 88)
    raw = ctx.select("file", "line_no", F.col("upper").alias("u"))
    src = c.join(raw, ["file", "line_no"])
    clause = F.regexp_replace(_hit(F.col("u"), r"\bVALUES?\s+(.+?)$"), r"\.+$", "")
    token = r"'([^']*)'|\"([^\"]*)\"|([A-Z0-9][A-Z0-9-]*)"
    words = F.transform(F.regexp_extract_all(clause, F.lit(token), F.lit(0)), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    keep = F.filter(words, lambda x: (x != "") & ~F.upper(x).isin("THRU", "THROUGH"))
    return src.select("file", "line_no", "name", "owner", F.posexplode(keep).alias("p", "value")).select(
        "file", "line_no", "name", "owner", (F.col("p") + 1).cast("bigint").alias("value_no"), "value"
    )


# --- procedure division ------------------------------------------------------

def call_edges(ctx: DataFrame) -> DataFrame:
    """PERFORM, GO TO and CALL edges: (file, line_no, src, dst, kind, conditional).

    A line is conditional while the condition stack is not empty.  The stack
    pops only when it has something, so its depth is the balance minus the
    running minimum since it was last emptied.
    """
    low = running(procedure_lines_all(ctx), ["file", "seg"], "line_no", {"_low": ("min", F.col("bal"))}, look=True)
    up = F.col("upper")
    # Other lines go first: the filter on the kind below computes every pattern a second time.
    stmts = procedure_lines(low).where(_begins(up, "WHEN", "PERFORM", "GO", "CALL"))
    cond = F.col("bal") > F.col("_low")
    when_p = r"^WHEN\s+.+?\s+PERFORM\s+([A-Z0-9][A-Z0-9-]*)\s*\.?$"
    when_g = r"^WHEN\s+.+?\s+GO\s+TO\s+([A-Z0-9][A-Z0-9-]*)\s*\.?$"
    thru = rf"^PERFORM\s+({NAME})\s+THRU\s+({NAME})(?:\s+UNTIL\s+.+?)?\.?$"
    perform = rf"^PERFORM\s+({NAME})(?:\s+(?:VARYING|UNTIL)\s+.+|\s+(?:\d+|[A-Z0-9-]+)\s+TIMES)?\s*\.?$"
    goto = r"^GO\s+TO\s+([A-Z0-9-]+)\.?$"
    call = r"^CALL\s+['\"]?([A-Z0-9-]+)['\"]?(?:\s+USING\s+(.+?))?\.?$"
    # Kind and target only look at the hits.
    hits = stmts.select(
        "file", "line_no", "paragraph", cond.alias("_cond"), _hit(up, when_p).alias("w_perform"), _hit(up, when_g).alias("w_goto"),
        _hit(up, goto).alias("goto"), _hit(up, thru).alias("thru"), _hit(up, thru, 2).alias("dst_end"), _hit(up, perform).alias("perform"),
        _hit(up, call).alias("call"), _hit(up, call, 2).alias("using_list"),
    )
    h = F.col
    target = F.when(~h("perform").isin("VARYING", "UNTIL"), h("perform"))
    in_when = h("w_perform").isNotNull() | h("w_goto").isNotNull()
    kind = (
        F.when(h("w_perform").isNotNull(), "PERFORM").when(h("w_goto").isNotNull() | h("goto").isNotNull(), "GO TO")
        .when(h("thru").isNotNull(), "PERFORM THRU").when(target.isNotNull(), "PERFORM").when(h("call").isNotNull(), "CALL")
    )
    out = hits.select(
        "file", "line_no", h("paragraph").alias("src"), F.coalesce("w_perform", "w_goto", "goto", "thru", target, "call").alias("dst"),
        kind.alias("kind"), (h("_cond") | in_when).alias("conditional"), "dst_end", "using_list",
    )
    return out.where(F.col("kind").isNotNull())


def procedure_lines_all(ctx: DataFrame) -> DataFrame:
    return ctx.where(F.col("division") == "PROCEDURE")


def internal_calls(edges: DataFrame, pars: DataFrame) -> DataFrame:
    """PERFORM edges between known paragraphs of one file; a GO TO is no call."""
    known = pars.select("file", F.upper("paragraph").alias("dst")).distinct()
    e = edges.where(F.col("kind").isin("PERFORM", "PERFORM THRU")).withColumn("dst", F.upper("dst"))
    return e.join(known, ["file", "dst"], "left_semi")


def external_calls(edges: DataFrame) -> DataFrame:
    """Sub-programs called, with call count and sorted USING names."""
    calls = edges.where(F.col("kind") == "CALL")
    per = calls.groupBy("file", "dst").agg(F.count("*").alias("calls"))
    names = calls.select("file", "dst", F.explode(F.split("using_list", r"\s+")).alias("n")).distinct().groupBy("file", "dst").agg(
        F.expr("listagg(n, ' ') within group (order by n)").alias("using_names")
    )
    return per.join(names, ["file", "dst"], "left").select(
        "file", F.col("dst").alias("program"), "calls", F.coalesce("using_names", F.lit("")).alias("using_names")
    )


def statement_verb(up: Column) -> Column:
    word = F.regexp_replace(F.split(up, " ")[0], r"\.$", "")
    return F.when(word.isin(*VERBS), word)


def verb_counts(ctx: DataFrame) -> DataFrame:
    """Statements per verb and paragraph."""
    v = procedure_lines(ctx).select("file", "paragraph", statement_verb(F.col("upper")).alias("verb"))
    return v.where(F.col("verb").isNotNull() & F.col("paragraph").isNotNull()).groupBy("file", "paragraph", "verb").agg(F.count("*").alias("statements"))


def file_bindings(code: DataFrame) -> DataFrame:
    """SELECT name, ASSIGN target, FD/SD kind and record keys per file name.

    Most lines say nothing of files: those that do are marked in one pass and written, and only they are dealt and read again.
    """
    up = F.col("upper")
    one = r"^SELECT\s+([A-Z0-9-]+)\s+ASSIGN(?:\s+TO)?\s+('[^']+'|\"[^\"]+\"|[A-Z0-9-]+)"
    alone = r"^SELECT\s+([A-Z0-9-]+)\s*$"
    assign = r"^ASSIGN(?:\s+TO)?\s+('[^']+'|\"[^\"]+\"|[A-Z0-9-]+)"
    stop = r"^(ORGANIZATION|ACCESS|RECORD|FILE|SELECT|FD|SD)\b"
    alt = r"\bALTERNATE\s+RECORD\s+KEY\s+(?:IS\s+)?([A-Z0-9-]+)\b"
    prim = r"(?<!ALTERNATE )\bRECORD\s+KEY\s+(?:IS\s+)?([A-Z0-9-]+)\b"
    bare = lambda c: F.regexp_replace(c, "^['\"]|['\"]$", "")
    described = up.rlike(r"^(FD|SD)\s+([A-Z0-9-]+)\b")
    keyed = lambda p: F.when(up.contains("KEY"), _hit(up, p))
    # One pattern tells which lines to keep: a filter on the marks would run below them and compute each again.
    some = r"^(?:SELECT|ASSIGN|ORGANIZATION|ACCESS|RECORD|FILE|FD|SD)\b|^DATA DIVISION\.|KEY|INDEXED"
    marked = code.where(up.rlike(some)).select(
        "file", "line_no", F.coalesce(_hit(up, alone), F.when(up.rlike(stop), F.lit(""))).alias("_open_at"),
        F.coalesce(_hit(up, r"^SELECT\s+([A-Z0-9-]+)\b"), F.when(up == "DATA DIVISION.", F.lit(""))).alias("_select_at"),
        _hit(up, one).alias("_one"), _hit(up, assign).alias("_assign"), bare(F.coalesce(_hit(up, one, 2), _hit(up, assign))).alias("_target"),
        F.when(described, _hit(up, r"^(?:FD|SD)\s+([A-Z0-9-]+)\b")).alias("_fd"), F.when(described, F.substring(up, 1, 2)).alias("_fd_kind"),
        keyed(prim).alias("_prim"), keyed(alt).alias("_alt"), F.when(up.contains("INDEXED") & up.rlike(r"\bINDEXED\b"), 1).alias("_ix"),
    )
    told = cut(marked)
    filled = fill_forward(told, ["file"], "line_no", {"_open": F.col("_open_at"), "_select": F.col("_select_at")}, look=True)
    name = F.coalesce("_one", F.when(F.col("_assign").isNotNull(), F.nullif(F.col("_open"), F.lit(""))))
    binds = filled.where(name.isNotNull()).groupBy("file", name.alias("name")).agg(F.max_by("_target", "line_no").alias("assign_to"))
    fds = told.where(F.col("_fd").isNotNull()).groupBy("file", F.col("_fd").alias("name")).agg(F.max("_fd_kind").alias("fd_kind"))
    keys = filled.where(F.coalesce("_select", F.lit("")) != "").groupBy("file", F.col("_select").alias("name")).agg(
        F.min("_prim").alias("record_key"), F.min("_alt").alias("alternate_key"), F.max(F.coalesce("_ix", F.lit(0))).alias("_ix"),
    )
    return binds.join(fds, ["file", "name"], "full").join(keys, ["file", "name"], "left").select(
        "file", "name", "assign_to", "fd_kind", "record_key", "alternate_key", (F.coalesce("_ix", F.lit(0)) == 1).alias("indexed")
    )


def paragraph_symbols(ctx: DataFrame, items: DataFrame) -> DataFrame:
    """Data items read and written per paragraph: (file, paragraph, symbol, access)."""
    up = F.regexp_replace("upper", r"'[^']*'|\"[^\"]*\"", " ")
    s = procedure_lines(ctx).select("file", "paragraph", "line_no", up.alias("u"), statement_verb(F.col("upper")).alias("verb"))
    s = s.where(F.col("verb").isNotNull() & F.col("paragraph").isNotNull())
    u, verb = F.col("u"), F.col("verb")
    after = lambda word: F.when(u.contains(f" {word} "), F.substring_index(u, f" {word} ", -1)).otherwise("")
    before = lambda word: F.substring_index(u, f" {word} ", 1)
    writes = (
        F.when(verb.isin("MOVE", "ADD"), after("TO")).when(verb == "SUBTRACT", after("FROM")).when(verb == "COMPUTE", F.substring_index(u, "=", 1))
        .when(verb.isin("MULTIPLY", "DIVIDE"), after("GIVING")).when(verb == "READ", after("INTO"))
        .when(verb.isin("ACCEPT", "WRITE", "REWRITE", "DELETE", "INITIALIZE"), before("FROM")).otherwise("")
    )
    reads = (
        F.when(verb.isin("MOVE", "ADD"), before("TO")).when(verb == "SUBTRACT", before("FROM")).when(verb == "COMPUTE", F.substring_index(u, "=", -1))
        .when(verb.isin("MULTIPLY", "DIVIDE"), before("GIVING")).when(verb.isin("WRITE", "REWRITE"), after("FROM"))
        .when(verb.isin("DISPLAY", "IF", "EVALUATE", "WHEN", "SEARCH", "CALL", "STRING", "UNSTRING", "INSPECT"), u)
        .when(verb == "PERFORM", after("UNTIL")).otherwise("")
    )
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[A-Z0-9][A-Z0-9-]*"), F.lit(0))
    tag = lambda c, a: F.transform(words(c), lambda w: F.struct(w.alias("symbol"), F.lit(a).alias("access")))
    used = s.select("file", "paragraph", F.explode(F.concat(tag(reads, "R"), tag(writes, "W"))).alias("t"))
    used = used.select("file", "paragraph", "t.symbol", "t.access").distinct()
    names = items.select("file", F.col("name").alias("symbol")).distinct()
    return used.join(names, ["file", "symbol"], "left_semi").select("file", "paragraph", "symbol", "access")


def dead_paragraphs(pars: DataFrame, edges: DataFrame) -> DataFrame:
    """Paragraphs that are not first and never a target."""
    first = pars.groupBy("file").agg(F.min("line_no").alias("line_no"))
    targets = edges.where(F.col("kind") != "CALL").select("file", F.upper("dst").alias("paragraph")).distinct()
    like = F.lit(False)
    for prefix in VARIABLE_LIKE:
        like = like | F.upper("paragraph").startswith(prefix)
    rest = pars.where(~like).join(first, ["file", "line_no"], "left_anti")
    return rest.join(targets, ["file", "paragraph"], "left_anti").select("file", "paragraph", "line_no")


def unused_items(items: DataFrame, ctx: DataFrame) -> DataFrame:
    """Elementary items never named in the procedure division."""
    words = F.explode(F.regexp_extract_all("upper", F.lit(r"[A-Z0-9][A-Z0-9-]*"), F.lit(0)))
    used = procedure_lines_all(ctx).select("file", words.alias("name")).distinct()
    own = items.where((F.col("kind") != "group") & (F.col("name") != "FILLER")).select("file", "name", "line_no")
    return own.join(used, ["file", "name"], "left_anti")


def write_only_items(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Elementary items written but never read."""
    agg = symbols.groupBy("file", F.col("symbol").alias("name")).agg(
        F.max(F.col("access") == "W").alias("w"), F.max(F.col("access") == "R").alias("r")
    )
    own = items.where(F.col("kind") != "group").select("file", "name").distinct()
    return agg.where(F.col("w") & ~F.col("r")).join(own, ["file", "name"], "left_semi").select("file", "name")


def column_warnings(code: DataFrame) -> DataFrame:
    """Lines with text beyond column 72."""
    return code.where(F.col("beyond_72")).select("file", "line_no")


def missing_descriptions(bindings: DataFrame) -> DataFrame:
    """Selected files without an FD or SD entry."""
    return bindings.where(F.col("assign_to").isNotNull() & F.col("fd_kind").isNull()).select("file", "name")


def structure_errors(ctx: DataFrame, items: DataFrame, bindings: DataFrame) -> DataFrame:
    """Blocking findings: (file, error, name)."""
    row = lambda df, e, c: df.select("file", F.lit(e).alias("error"), F.col(c).alias("name"))
    dup = items.where(F.col("name") != "FILLER").groupBy("file", "name").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keys = bindings.select("file", "name", F.explode(F.array_compact(F.array("record_key", "alternate_key"))).alias("key"), "fd_kind")
    names = items.select("file", F.col("name").alias("key")).distinct()
    lost = keys.where(F.col("fd_kind").isNotNull()).join(names, ["file", "key"], "left_anti")
    up = F.col("upper")
    token = F.regexp_replace(up, r"\.$", "")
    reserved = ctx.where((F.col("division") == "PROCEDURE") & _header_like(True) & token.isin(*RESERVED) & ~token.isin(*QUIET_RESERVED))
    loop = rf"^PERFORM\s+(?:{NAME}\s+)?VARYING\s+([A-Z0-9-]+)\s"
    index = items.where(F.col("indexed_by").isNotNull()).select("file", F.explode(F.split("indexed_by", r"\s+")).alias("it"))
    declared = items.select("file", F.col("name").alias("it")).unionByName(index).distinct()
    loops = procedure_lines_all(ctx).where(up.rlike(loop)).select("file", _hit(up, loop).alias("it")).distinct()
    out = row(dup, "duplicate name", "name")
    for part in (
        row(missing_descriptions(bindings), "missing description", "name"), row(lost, "key not in record", "key"),
        row(reserved.select("file", token.alias("name")).distinct(), "reserved paragraph name", "name"),
        row(loops.join(declared, ["file", "it"], "left_anti"), "undeclared loop index", "it"),
    ):
        out = out.unionByName(part)
    return out


def control_points(ctx: DataFrame) -> DataFrame:
    """Loops and branches: (file, paragraph, line_no, kind, condition)."""
    up = F.col("upper")
    vary = rf"^PERFORM\s+(?:{NAME}\s+)?VARYING\s+[A-Z0-9-]+\s+FROM\s+.+?\s+BY\s+.+?\s+UNTIL\s+(.+?)\.?$"
    until = rf"^PERFORM\s+(?:{NAME}\s+(?:THRU\s+{NAME}\s+)?)?UNTIL\s+(.+?)\.?$"
    times = rf"^PERFORM\s+(?:{NAME}\s+)?((?:\d+|[A-Z0-9-]+)\s+TIMES)\.?$"
    hits = procedure_lines(ctx).where(_begins(up, "IF", "EVALUATE", "PERFORM")).select(
        "file", "paragraph", "line_no", F.regexp_replace(_hit(up, r"^IF\s+(.+?)\.?$"), r"\s+THEN$", "").alias("i"),
        _hit(up, r"^EVALUATE\s+(.+?)\.?$").alias("e"), _hit(up, vary).alias("v"), _hit(up, until).alias("u"), _hit(up, times).alias("t"),
    )
    some = lambda c: F.col(c).isNotNull()
    kind = (
        F.when(some("i"), "IF").when(some("e"), "EVALUATE").when(some("v"), "PERFORM_VARYING").when(some("u"), "PERFORM_UNTIL")
        .when(some("t"), "PERFORM_TIMES")
    )
    cond = F.coalesce("i", "e", "v", "u", F.when(some("t"), F.lit("")))
    return hits.select("file", "paragraph", "line_no", kind.alias("kind"), cond.alias("condition")).where(F.col("kind").isNotNull())


LOOPS = ("PERFORM_VARYING", "PERFORM_UNTIL", "PERFORM_TIMES")


def risk_flags(ctx: DataFrame, items: DataFrame, bindings: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """One row per file with boolean risk flags."""
    up = F.col("upper")
    is_if, end_if = up.rlike(r"^IF "), up.contains("END-IF")
    nest = running(ctx, ["file"], "line_no", {"_b": ("sum", is_if.cast("bigint") - end_if.cast("bigint"))})
    nest = running(nest, ["file"], "line_no", {"_m": ("min", F.col("_b"))})
    peak = F.col("_b") - F.least(F.col("_m"), F.lit(0)) + (is_if & end_if).cast("bigint")
    base = nest.groupBy("file").agg((F.max(F.when(is_if, peak).otherwise(0)) > 1).alias("nested_conditionals"))
    verb = statement_verb(up)
    stmt = procedure_lines(ctx).groupBy("file").agg(
        F.max(verb.isin(*ARITHMETIC)).alias("arithmetic_expression"),
    )
    pts = points.groupBy("file").agg(
        F.max(F.col("kind").isin("IF", "EVALUATE")).alias("conditional_logic"), F.max(F.col("kind").isin(*LOOPS)).alias("loop_logic")
    )
    its = items.groupBy("file").agg(
        F.max(F.col("kind") == "redefines").alias("redefines_present"), F.max(F.col("kind") == "array").alias("occurs_present")
    )
    fil = bindings.select("file").distinct().withColumn("file_io_present", F.lit(True))
    edg = edges.groupBy("file").agg(
        F.max(F.col("kind") == "GO TO").alias("goto_present"), F.max(F.col("kind") == "CALL").alias("external_calls_present")
    )
    out = base
    for df in (stmt, pts, its, fil, edg):
        out = out.join(df, "file", "left")
    flags = ["arithmetic_expression", "conditional_logic", "loop_logic", "goto_present", "redefines_present", "occurs_present",
             "file_io_present", "external_calls_present", "nested_conditionals"]
    return out.select("file", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def complexity_tier(lines: DataFrame, ctx: DataFrame, bindings: DataFrame, copies: DataFrame, edges: DataFrame) -> DataFrame:
    """Score and tier per program from sizes and features."""
    up = F.col("upper")
    n_lines = lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.max(F.upper("text").contains("EXEC SQL")).alias("has_sql")
    )
    feats = ctx.groupBy("file").agg(F.max((F.col("division") == "PROCEDURE") & up.rlike(r"^SORT\s")).alias("has_sort"))
    files = bindings.groupBy("file").agg(F.count("*").alias("files"), F.max("indexed").alias("has_indexed"))
    books = copies.groupBy("file").agg(F.count_distinct("copybook").alias("copybooks"))
    subs = edges.where(F.col("kind") == "CALL").groupBy("file").agg(F.count_distinct("dst").alias("subprograms"))
    out = n_lines
    for df in (feats, files, books, subs):
        out = out.join(df, "file", "left")
    num = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("files", "copybooks", "subprograms")}
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("has_sql", "has_sort", "has_indexed")}
    out = out.withColumns({**num, **flag})
    n, f, k, s = (F.col(c) for c in ("lines", "files", "copybooks", "subprograms"))
    sql, srt, ix = F.col("has_sql"), F.col("has_sort"), F.col("has_indexed")
    score = (
        F.when(n > 1000, 3).when(n > 500, 2).otherwise(0) + F.when(f >= 6, 3).when(f >= 3, 2).otherwise(0)
        + F.when(k >= 10, 5).when(k >= 5, 2).otherwise(0) + F.when(sql, 4).otherwise(0) + F.when(srt, 3).otherwise(0)
        + F.when(s > 0, 3).otherwise(0) + F.when(ix, 3).otherwise(0)
    )
    small = (n < 400) & ~sql & ~srt & ~ix & (s == 0) & (f <= 2)
    score = F.when(small, F.least(score, F.lit(4))).otherwise(score).cast("bigint")
    tier = F.when(F.col("score") <= 4, "Standard").when(F.col("score") <= 12, "Complex").otherwise("Enterprise")
    return out.withColumn("score", score).select("file", "lines", "files", "copybooks", "subprograms", "has_sql", "has_sort", "has_indexed", "score", tier.alias("tier"))


# --- segments ----------------------------------------------------------------

def segments(pars: DataFrame, calls: DataFrame) -> DataFrame:
    """Root paragraph of each paragraph: (file, paragraph, segment).

    A paragraph with exactly one call site, not the entry, belongs to its
    caller; others start a segment.  Roots are found by pointer doubling, so
    rounds grow with the logarithm of the chain length.  A ring of paragraphs
    that only call each other takes its first paragraph as root.
    """
    entry = pars.groupBy("file").agg(F.min("line_no").alias("line_no")).withColumn("_entry", F.lit(True))
    sites = calls.where(F.col("src").isNotNull()).groupBy("file", F.col("dst").alias("paragraph")).agg(F.count("*").alias("n"), F.min(F.upper("src")).alias("caller"))
    node = pars.withColumn("paragraph", F.upper("paragraph")).groupBy("file", "paragraph").agg(F.min("line_no").alias("line_no"))
    node = node.join(entry, ["file", "line_no"], "left").join(sites, ["file", "paragraph"], "left")
    own = F.coalesce(F.col("_entry"), F.lit(False)) | F.coalesce(F.col("n") != 1, F.lit(True)) | (F.col("caller") == F.col("paragraph"))
    up = F.when(own, F.col("paragraph")).otherwise(F.col("caller"))
    state = cut(node.select("file", "paragraph", "line_no", up.alias("up"), F.struct("line_no", "paragraph").alias("least"), own.alias("at_root")))
    while True:
        nxt = state.select("file", F.col("paragraph").alias("up"), F.col("up").alias("_up2"), F.col("least").alias("_least2"), F.col("at_root").alias("_root2"))
        j = state.join(nxt, ["file", "up"], "left")
        arrived = F.coalesce(F.col("at_root") | F.col("_root2"), F.lit(True))
        lower = F.least("least", F.coalesce("_least2", "least"))
        new = cut(
            j.select(
                "file", "paragraph", "line_no", F.coalesce("_up2", "up").alias("up"), lower.alias("least"), arrived.alias("at_root"),
                ((arrived & ~F.col("at_root")) | (~arrived & (lower < F.col("least")))).alias("_busy"),
            )
        )
        state = new.drop("_busy")
        if new.where(F.col("_busy")).isEmpty():
            break
    seg = F.when(F.col("at_root"), F.col("up")).otherwise(F.col("least.paragraph"))
    return state.select("file", "paragraph", seg.alias("segment"))


def segment_complexity(segs: DataFrame, points: DataFrame, verbs: DataFrame) -> DataFrame:
    """3 per loop, 2 per branch, a half per statement; low below 5, medium below 15."""
    p = points.groupBy("file", F.upper("paragraph").alias("paragraph")).agg(
        F.count_if(F.col("kind").isin(*LOOPS)).alias("loops"), F.count_if(F.col("kind").isin("IF", "EVALUATE")).alias("branches")
    )
    v = verbs.groupBy("file", F.upper("paragraph").alias("paragraph")).agg(F.sum("statements").alias("ops"))
    j = segs.join(p, ["file", "paragraph"], "left").join(v, ["file", "paragraph"], "left")
    zero = F.lit(0)
    agg = j.groupBy("file", "segment").agg(
        F.count("*").alias("paragraphs"), F.sum(F.coalesce("loops", zero)).alias("loops"), F.sum(F.coalesce("branches", zero)).alias("branches"),
        F.sum(F.coalesce("ops", zero)).alias("ops"),
    )
    score = F.lit(6) * F.col("loops") + F.lit(4) * F.col("branches") + F.col("ops")
    return agg.withColumn("score_x2", score.cast("bigint")).withColumn(
        "complexity", F.when(F.col("score_x2") < 10, "low").when(F.col("score_x2") < 30, "medium").otherwise("high")
    )


def shared_symbols(symbols: DataFrame, segs: DataFrame) -> DataFrame:
    """Symbols used by more than one segment and written by at least one."""
    s = symbols.withColumn("paragraph", F.upper("paragraph")).join(segs, ["file", "paragraph"])
    agg = s.groupBy("file", "symbol").agg(F.count_distinct("segment").alias("segments"), F.max(F.col("access") == "W").alias("_w"))
    return agg.where((F.col("segments") > 1) & F.col("_w")).drop("_w")


def impact_slice(targets: DataFrame, calls: DataFrame, pars: DataFrame) -> DataFrame:
    """Target, callees and callers one hop away, and whether to widen: (file, target, paragraph, role).

    ``targets(file, target)``; all targets are sliced in one job.  The first paragraph of the file joins as ``entry``
    where it calls anything or the target has a caller.
    """
    # Read by four joins: written once.
    c = cut(calls.where(F.col("src").isNotNull()).select("file", F.upper("src").alias("src"), F.upper("dst").alias("dst")).distinct())
    me = targets.select("file", "target", F.col("target").alias("paragraph"), F.lit(0).alias("role"))
    out = targets.join(c.withColumnRenamed("src", "target"), ["file", "target"]).select("file", "target", F.col("dst").alias("paragraph"), F.lit(1).alias("role"))
    inc = targets.join(c.withColumnRenamed("dst", "target"), ["file", "target"]).select("file", "target", F.col("src").alias("paragraph"), F.lit(2).alias("role"))
    first = pars.groupBy("file").agg(F.upper(F.min_by("paragraph", "line_no")).alias("paragraph"))
    busy = c.select("file", F.col("src").alias("paragraph")).distinct().withColumn("_calls", F.lit(True))
    called = c.select("file", F.col("dst").alias("target")).distinct().withColumn("_called", F.lit(True))
    start = targets.join(first.join(busy, ["file", "paragraph"], "left"), "file").join(called, ["file", "target"], "left")
    start = start.where(F.col("_calls").isNotNull() | F.col("_called").isNotNull()).select("file", "target", "paragraph", F.lit(3).alias("role"))
    every = me.unionByName(out).unionByName(inc).unionByName(start).groupBy("file", "target", "paragraph").agg(F.min("role").alias("role"))
    size = every.groupBy("file", "target").agg(F.count("*").alias("slice_size"))
    names = F.when(F.col("role") == 0, "target").when(F.col("role") == 1, "callee").when(F.col("role") == 2, "caller").otherwise("entry")
    return every.join(size, ["file", "target"]).select(
        "file", "target", "paragraph", names.alias("role"), "slice_size", F.when(F.col("slice_size") > MAX_SLICE, "section").otherwise("paragraph").alias("scope")
    )


# --- tests and chunks --------------------------------------------------------

def boundary_cases(items: DataFrame, points: DataFrame, ctx: DataFrame) -> DataFrame:
    """Values around OCCURS sizes, loop and EVALUATE thresholds, and early exits."""
    three = lambda n: F.array(*[(n + d).cast("string") for d in (-1, 0, 1)])
    none = F.lit(None).cast("string")
    occ = items.where(F.col("occurs") > 0).select(
        "file", F.lit("OCCURS boundary").alias("case_type"), none.alias("paragraph"), F.col("name").alias("field"), three(F.col("occurs")).alias("v")
    )
    points = points.withColumn("limit", condition_threshold(F.col("condition")))
    limit = F.col("limit")
    lit_array = lambda *xs: F.array(*[F.lit(x) for x in xs])
    loop = points.where(F.col("kind").isin(*LOOPS)).select(
        "file", F.lit("loop boundary").alias("case_type"), "paragraph", F.col("kind").alias("field"),
        F.when(limit.isNotNull(), three(limit)).otherwise(lit_array("0", "1", "2")).alias("v"),
    )
    ev = points.where(F.col("kind") == "EVALUATE").select(
        "file", F.lit("EVALUATE threshold").alias("case_type"), "paragraph", F.col("condition").alias("field"),
        F.when(limit.isNotNull(), three(limit)).otherwise(lit_array("0", "1")).alias("v"),
    )
    up = F.col("upper")
    ex = procedure_lines(ctx).where(up.rlike(r"^EXIT\s+(PARAGRAPH|PERFORM)")).select(
        "file", F.lit("early exit").alias("case_type"), "paragraph",
        F.when(up.rlike(r"^EXIT\s+PERFORM\s+CYCLE"), "EXIT_PERFORM_CYCLE").when(up.rlike(r"^EXIT\s+PERFORM"), "EXIT_PERFORM").otherwise("EXIT_PARAGRAPH").alias("field"),
        lit_array("early exit path").alias("v"),
    )
    every = occ.unionByName(loop).unionByName(ev).unionByName(ex).distinct()
    return every.select("file", "case_type", "paragraph", "field", F.explode("v").alias("case_value"))


def structure_checks(items: DataFrame, edges: DataFrame, pars: DataFrame) -> DataFrame:
    """Pass/fail rows: (file, check_id, severity, passed)."""
    sym = items.select("file", F.concat(F.lit("SYM_"), F.col("name")).alias("check_id"), F.lit("critical").alias("severity"), (F.col("pic").isNotNull() | F.col("kind").isNotNull()).alias("passed"))
    known = pars.select("file", F.upper("paragraph").alias("_p")).distinct().withColumn("_ok", F.lit(True))
    e = edges.where(F.col("kind").isin("PERFORM", "PERFORM THRU")).withColumn("_p", F.upper("dst")).join(known, ["file", "_p"], "left")
    call = e.select(
        "file", F.concat(F.lit("CALL_"), F.coalesce("src", F.lit("None")), F.lit("_TO_"), F.col("dst")).alias("check_id"), F.lit("critical").alias("severity"),
        F.col("_ok").isNotNull().alias("passed"),
    )
    res = pars.select("file", F.concat(F.lit("RESERVED_"), F.col("paragraph")).alias("check_id"), F.lit("critical").alias("severity"), (~F.upper("paragraph").isin(*RESERVED)).alias("passed"))
    return sym.unionByName(call).unionByName(res)


def _next_at_or_after(starts: DataFrame) -> DataFrame:
    """For each start: the first start at least one block further down in its file."""
    ahead = starts.select("file", F.col("line_no").alias("origin"), (F.lit(2) * (F.col("line_no") + BLOCK_LINES)).alias("k"), F.lit(None).cast("bigint").alias("at"))
    here = starts.select("file", F.lit(None).cast("bigint").alias("origin"), (F.lit(2) * F.col("line_no") + 1).alias("k"), F.col("line_no").alias("at"))
    mixed = ahead.unionByName(here).withColumn("pos", F.lit(2**40) - F.col("k"))
    run = fill_forward(mixed, ["file"], "pos", {"next_start": F.col("at")})
    return run.where(F.col("origin").isNotNull()).select("file", F.col("origin").alias("line_no"), "next_start")


def chunk_lines(lines: DataFrame) -> DataFrame:
    """Line ranges to work on: (file, start_line, end_line, chunk_type).

    Up to 600 lines: one chunk.  Up to 1500: cut at divisions and sections.
    Above: blocks of whole paragraphs of at least 120 lines, with 10 lines of
    overlap on both sides.  Which paragraphs open a block is found by pointer
    doubling over paragraph starts.
    """
    size = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    sized = lines.join(size, "file")
    t = F.col("text")
    whole = size.where(F.col("n") <= WHOLE_LINES).select("file", F.lit(1).cast("bigint").alias("start_line"), F.col("n").alias("end_line"), F.lit("whole_program").alias("chunk_type"))
    section = r"(?i)^\s{0,7}([A-Z0-9][A-Z0-9-]*)\s+(DIVISION|SECTION)\s*\.?"
    mid = sized.where((F.col("n") > WHOLE_LINES) & (F.col("n") <= SECTION_LINES))
    run = running_sum(mid, ["file"], "line_no", "part", (t.rlike(section) & (F.col("line_no") > 1)).cast("bigint"))
    cuts = run.groupBy("file", "part").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(F.trim("text") != "").alias("_full")
    ).where(F.col("_full")).select("file", "start_line", "end_line", F.lit("section").alias("chunk_type"))
    big = sized.where(F.col("n") > SECTION_LINES)
    starts = cut(big.where(t.rlike(r"^\s{0,7}([A-Z0-9][A-Z0-9-]*)\.\s*$")).select("file", "line_no", "n"))
    jump = cut(_next_at_or_after(starts).where(F.col("next_start").isNotNull()))
    links = jump
    open_ = cut(starts.groupBy("file").agg(F.min("line_no").alias("line_no")))
    while not jump.isEmpty():
        more = open_.join(jump, ["file", "line_no"]).select("file", F.col("next_start").alias("line_no"))
        open_ = cut(open_.unionByName(more).distinct())
        hop = jump.select("file", F.col("line_no").alias("next_start"), F.col("next_start").alias("far"))
        jump = cut(jump.join(hop, ["file", "next_start"]).select("file", "line_no", F.col("far").alias("next_start")))
    opened = open_.join(links, ["file", "line_no"], "left").join(size, "file")
    last = F.col("next_start").isNull()
    blocks = opened.select(
        "file", F.greatest(F.col("line_no") - OVERLAP_LINES, F.lit(1)).alias("start_line"),
        F.when(last, F.col("n")).otherwise(F.least(F.col("next_start") - 1 + OVERLAP_LINES, F.col("n"))).alias("end_line"),
        F.lit("paragraph_block").alias("chunk_type"),
    )
    flat = size.where(F.col("n") > SECTION_LINES).join(starts.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(1).cast("bigint").alias("start_line"), F.col("n").alias("end_line"), F.lit("whole_program").alias("chunk_type")
    )
    return whole.unionByName(cuts).unionByName(blocks).unionByName(flat)


def usable_chunks(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks with a verdict: at least five lines and a business or data marker.

    Marked lines are counted with a running sum; a chunk looks up the sum at
    its two ends, so no line is matched against a range.
    """
    up = F.upper("text")
    marked = F.lit(False)
    for m in USABLE_MARKERS:
        marked = marked | up.contains(m)
    run = running_sum(lines, ["file"], "line_no", "seen", marked.cast("bigint")).select("file", "line_no", "seen")
    at = lambda c, name: run.select("file", F.col("line_no").alias(c), F.col("seen").alias(name))
    j = chunks.withColumn("_before", F.col("start_line") - 1)
    j = j.join(at("end_line", "_hi"), ["file", "end_line"]).join(at("_before", "_lo"), ["file", "_before"], "left")
    n = F.col("end_line") - F.col("start_line") + 1
    hits = F.col("_hi") - F.coalesce("_lo", F.lit(0))
    reason = F.when(n < 5, "too_few_lines").when(hits == 0, "no_business_or_data_markers")
    return j.select("file", "start_line", "end_line", "chunk_type", reason.isNull().alias("usable"), reason.alias("reason"))


# --- projects ----------------------------------------------------------------

def project_order(lines: DataFrame) -> DataFrame:
    """Files named as copybooks by others come last, then by name: (file, referenced)."""
    names = lines.select("file").distinct()
    refs = copy_statements(lines).select(F.col("copybook").alias("file")).distinct().withColumn("_r", F.lit(True))
    return names.join(refs, "file", "left").select("file", F.col("_r").isNotNull().alias("referenced")).orderBy("referenced", "file")


def project_complexity(files: DataFrame, group: str, label: str) -> DataFrame:
    """One label per project: the only tier present, else Mixed, Unknown when none."""
    low = F.lower(F.trim(label))
    rank = F.when(low.contains("mix"), 9).when(low.isin("low", "simple"), 1).when(low.isin("medium", "med"), 2).when(low.isin("high", "complex"), 3)
    agg = files.groupBy(group).agg(F.min(rank).alias("a"), F.max(rank).alias("b"))
    name = lambda c: F.when(c == 1, "Simple").when(c == 2, "Medium").otherwise("Complex")
    out = F.when(F.col("a").isNull(), "Unknown").when((F.col("b") == 9) | (F.col("a") != F.col("b")), "Mixed").otherwise(name(F.col("a")))
    return agg.select(group, out.alias("complexity"))
