"""Registered queries: code estate and job control inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.adapters import PROGRAM_TEXT
from creditloom.catalog.registry import big, query
from creditloom.functions import text as tx
from creditloom.functions import pic
from creditloom.plans import copybooks, estate, jcl
from creditloom.session import cut

SRC = "source_line"
RESERVED_HERE = "'FILE-CONTROL', 'EXIT', 'GOBACK', 'CONTINUE'"
CODE_SQL = """co0 AS (SELECT file, line_no, text, SUBSTR(text, 7, 1) AS ind, TRIM(REGEXP_REPLACE(SUBSTR(text, 8, 65), '\\s+', ' ', 'g')) AS code, SUBSTR(text, 8, 65) AS body FROM source_line),
 co AS (SELECT *, UPPER(code) AS up, LENGTH(body) - LENGTH(LTRIM(body)) <= 3 AS area_a, TRIM(SUBSTR(text, 73, 8)) <> '' AS beyond_72 FROM co0 WHERE ind NOT IN ('*', '/') AND code <> '')"""
CTX_SQL = CODE_SQL + f""",
 m AS (SELECT *, NULLIF(REGEXP_EXTRACT(up, '^(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\\s+DIVISION', 1), '') AS dv,
  CASE WHEN REGEXP_MATCHES(up, '^[A-Z0-9][A-Z0-9-]*\\.$') AND area_a AND RTRIM(up, '.') NOT IN ({RESERVED_HERE}) THEN RTRIM(code, '.') END AS hd FROM co),
 x0 AS (SELECT *, LAST_VALUE(dv IGNORE NULLS) OVER w AS division, LAST_VALUE(CASE WHEN dv IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS dl,
  LAST_VALUE(hd IGNORE NULLS) OVER w AS pa, LAST_VALUE(CASE WHEN hd IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS pl FROM m WINDOW w AS (PARTITION BY file ORDER BY line_no)),
 cx AS (SELECT *, CASE WHEN division = 'PROCEDURE' AND pl > dl THEN pa END AS paragraph, CASE WHEN division = 'PROCEDURE' AND pl > dl THEN pl END AS para_line FROM x0),
 st AS (SELECT * FROM cx WHERE division = 'PROCEDURE' AND NOT COALESCE(para_line = line_no, FALSE) AND NOT REGEXP_MATCHES(up, '(DIVISION|SECTION)\\.$'))"""
ITEM_SQL = CTX_SQL + """,
 i0 AS (SELECT file, line_no, CAST(REGEXP_EXTRACT(up, '^(\\d{2})\\s', 1) AS BIGINT) AS level, REGEXP_EXTRACT(up, '^\\d{2}\\s+([A-Z0-9-]+)', 1) AS name, up FROM cx WHERE division = 'DATA' AND REGEXP_MATCHES(up, '^\\d{2}\\s+[A-Z0-9-]+')),
 i1 AS (SELECT *, NULLIF(REGEXP_EXTRACT(up, 'PIC ([A-Z0-9().,]*[A-Z0-9)])', 1), '') AS pic, NULLIF(REGEXP_EXTRACT(up, '(COMP-3)', 1), '') AS usage, CAST(NULLIF(REGEXP_EXTRACT(up, 'OCCURS (\\d+) TIMES', 1), '') AS BIGINT) AS occurs,
   NULLIF(TRIM(REGEXP_REPLACE(REGEXP_EXTRACT(up, 'VALUES? (.+?)\\.?$', 1), '\\.$', '')), '') AS value FROM i0),
 it AS (SELECT i.*, (SELECT p.name FROM i1 p WHERE p.file = i.file AND p.line_no < i.line_no AND p.level < i.level ORDER BY p.line_no DESC LIMIT 1) AS parent,
   CASE WHEN level = 88 THEN 'condition' WHEN occurs IS NOT NULL THEN 'array' WHEN pic IS NULL THEN 'group' WHEN REGEXP_MATCHES(pic, '[XA]') THEN 'string' WHEN CONTAINS(pic, '9') THEN 'numeric' ELSE 'unknown' END AS kind FROM i1 i)"""
# Edges of the test programs: the only conditional lines stand between an IF or
# a WHEN and the point where the stack is emptied.
EDGE_SQL = CTX_SQL + """,
 ed AS (SELECT file, line_no, paragraph AS src, COALESCE(NULLIF(REGEXP_EXTRACT(up, '^WHEN .+? PERFORM ([A-Z0-9-]+)', 1), ''), NULLIF(REGEXP_EXTRACT(up, '^GO TO ([A-Z0-9-]+)', 1), ''), NULLIF(REGEXP_EXTRACT(up, '^PERFORM ([A-Z0-9-]+)', 1), ''), NULLIF(REGEXP_EXTRACT(up, '^CALL ''([A-Z0-9-]+)''', 1), '')) AS dst,
  CASE WHEN up LIKE 'GO TO %' THEN 'GO TO' WHEN up LIKE 'CALL %' THEN 'CALL' ELSE 'PERFORM' END AS kind, NULLIF(REGEXP_EXTRACT(up, 'USING (.+?)\\.?$', 1), '') AS using_list,
  up LIKE 'WHEN %' OR EXISTS (SELECT 1 FROM cx a WHERE a.file = st.file AND a.paragraph = st.paragraph AND a.line_no < st.line_no AND a.up LIKE 'IF %' AND
   (SELECT COUNT(*) FROM cx e WHERE e.file = st.file AND e.paragraph = st.paragraph AND e.line_no < st.line_no AND e.up LIKE '%END-IF%') < (SELECT COUNT(*) FROM cx f WHERE f.file = st.file AND f.paragraph = st.paragraph AND f.line_no < st.line_no AND f.up LIKE 'IF %')) AS conditional
  FROM st WHERE REGEXP_MATCHES(up, '^(PERFORM|GO TO|CALL|WHEN .+ PERFORM) '))"""
NLINES = len(PROGRAM_TEXT)


def ctx(s):
    return estate.with_context(estate.code_lines(s(SRC)))


def kept(s):
    """The context written once, for queries that read it several times; none of them reads the code as it was typed."""
    return cut(ctx(s).drop("code", "beyond_72"))


@query("k1_classify_format", SRC, "SELECT file, COUNT(*) AS lines, COUNT(*) FILTER (REGEXP_MATCHES(text, '^[ 0-9]{6}.')) AS fixed_like, CASE WHEN COUNT(*) FILTER (REGEXP_MATCHES(text, '^[ 0-9]{6}.')) >= GREATEST(1, COUNT(*) // 3) THEN 'fixed' ELSE 'free' END AS format FROM source_line WHERE TRIM(text) <> '' GROUP BY file")
def _(s):
    return estate.classify_format(s(SRC))


@query("k1_classify_documents", sql="""WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS t FROM documents), r AS (SELECT doc_id, REGEXP_REPLACE(t, '[\\r\\n]+$', '') AS t FROM l)
 SELECT CAST(doc_id AS STRING) AS file, COUNT(*) FILTER (TRIM(t, ' ') <> '') AS lines, COUNT(*) FILTER (TRIM(t, ' ') <> '' AND LENGTH(t) >= 7 AND REGEXP_MATCHES(t, '^[ 0-9]{6}')) AS fixed_like,
 CASE WHEN COUNT(*) FILTER (TRIM(t, ' ') <> '') = 0 OR COUNT(*) FILTER (TRIM(t, ' ') <> '' AND LENGTH(t) >= 7 AND REGEXP_MATCHES(t, '^[ 0-9]{6}')) >= GREATEST(1, COUNT(*) FILTER (TRIM(t, ' ') <> '') // 3) THEN 'fixed' ELSE 'free' END AS format FROM r GROUP BY doc_id""")
def _(s):
    d = s.table("documents").select(F.col("doc_id").cast("string").alias("file"), F.explode(F.split("text", "\n")).alias("text"))
    return estate.classify_format(d)


@query("k2_code_lines", SRC, f"WITH {CODE_SQL} SELECT file, line_no, up AS upper, area_a, beyond_72 FROM co")
def _(s):
    lines = s(SRC)
    return estate.code_lines(lines, estate.classify_format(lines)).select("file", "line_no", "upper", "area_a", "beyond_72")


@query("k2_column_warnings", SRC, f"WITH {CODE_SQL} SELECT file, line_no FROM co WHERE beyond_72")
def _(s):
    return estate.column_warnings(estate.code_lines(s(SRC)))


@query("e6_owner_paragraph", SRC, f"WITH {CTX_SQL} SELECT file, line_no, paragraph FROM cx")
def _(s):
    return estate.owner_paragraph(ctx(s))


@query("k9_paragraphs", SRC, f"WITH {CTX_SQL} SELECT file, paragraph, line_no FROM cx WHERE para_line = line_no")
def _(s):
    return estate.paragraphs(ctx(s))


COPY_SQL = """cp AS (SELECT file, line_no, UPPER(REGEXP_EXTRACT(text, '^\\s+COPY ([A-Z0-9]+)', 1)) AS copybook, COALESCE(REGEXP_EXTRACT(text, 'REPLACING (.*)\\.', 1), '') AS replacing FROM {t} WHERE SUBSTR(text, 7, 1) NOT IN ('*', '/') AND REGEXP_MATCHES(text, '^\\s+COPY [A-Z0-9]+'))"""


@query("k3_copy_edges", "source_line book_line", f"""WITH {COPY_SQL.format(t='source_line')}, {COPY_SQL.format(t='book_line').replace('cp AS', 'cb AS')}
 SELECT file, line_no, copybook, 'DEFAULT' AS library, replacing FROM cp UNION ALL SELECT file, line_no, copybook, 'DEFAULT', replacing FROM cb""")
def _(s):
    return copybooks.copy_statements(s(SRC)).unionByName(copybooks.copy_statements(s("book_line")))


@query("k4_copy_closure", "source_line book_line", f"""WITH RECURSIVE {COPY_SQL.format(t='source_line')}, {COPY_SQL.format(t='book_line').replace('cp AS', 'cb AS')},
 r AS (SELECT copybook AS src, copybook AS dst, 0 AS depth FROM (SELECT DISTINCT copybook FROM cp) UNION SELECT r.src, cb.copybook, r.depth + 1 FROM r JOIN cb ON cb.file = r.dst WHERE r.depth < 9),
 l AS (SELECT src, dst, MIN(depth) + 1 AS depth FROM r GROUP BY src, dst),
 ring AS (SELECT a.file AS b FROM cb a JOIN cb c ON c.file = a.copybook AND c.copybook = a.file)
 SELECT cp.file, l.dst AS copybook, MIN(l.depth) AS depth, CASE WHEN l.dst NOT IN (SELECT file FROM book_line) THEN 'unresolved' WHEN l.dst IN (SELECT b FROM ring) THEN 'circular' ELSE 'resolved' END AS status
 FROM cp JOIN l ON l.src = cp.copybook GROUP BY cp.file, l.dst""".replace("MIN(l.depth) AS depth", "CAST(MIN(l.depth) AS BIGINT) AS depth"))
def _(s):
    return copybooks.closure(s(SRC), s("book_line")).select("file", "copybook", "depth", "status")


@query("k5_expand_copies", "source_line book_line", """WITH RECURSIVE e AS (
  SELECT file, LPAD(CAST(line_no AS STRING), 9, '0') AS place, text, '|' AS path, CASE WHEN SUBSTR(text, 7, 1) NOT IN ('*', '/') THEN NULLIF(REGEXP_EXTRACT(text, '^\\s+COPY ([A-Z0-9]+)', 1), '') END AS book, FALSE AS rep FROM source_line
  UNION ALL
  SELECT e.file, CONCAT(e.place, '.', LPAD(CAST(b.line_no AS STRING), 9, '0')), CASE WHEN e.rep THEN REGEXP_REPLACE(b.text, '\\bFIELD\\b', 'ITEM', 'g') ELSE b.text END, CONCAT(e.path, e.book, '|'), NULLIF(REGEXP_EXTRACT(b.text, '^\\s+COPY ([A-Z0-9]+)', 1), ''), CONTAINS(b.text, 'REPLACING')
  FROM e JOIN book_line b ON b.file = e.book WHERE e.book IS NOT NULL AND NOT CONTAINS(e.path, CONCAT('|', e.book, '|')) AND LENGTH(e.place) < 100)
 SELECT file, place, CASE WHEN book IS NULL THEN text WHEN CONTAINS(path, CONCAT('|', book, '|')) THEN CONCAT('      * >>>CIRCULAR COPY: ', book, '<<<') ELSE CONCAT('      * >>>UNRESOLVED COPY: ', book, '<<<') END AS text
 FROM e WHERE book IS NULL OR CONTAINS(path, CONCAT('|', book, '|')) OR book NOT IN (SELECT file FROM book_line)""")
def _(s):
    return copybooks.expand(s(SRC), s("book_line"), marks=False)


# The code of a file in one string, literals taken out; continued literals are joined first.
SPLIT_SQL = """j AS (SELECT file, STRING_AGG(CASE WHEN SUBSTR(text, 7, 1) = '-' THEN SUBSTR(LTRIM(SUBSTR(text, 8)), 2) ELSE CONCAT(chr(10), SUBSTR(text, 8)) END, '' ORDER BY line_no) AS t FROM split_line WHERE SUBSTR(text, 7, 1) <> '*' GROUP BY file),
 q AS (SELECT file, UNNEST(REGEXP_EXTRACT_ALL(REGEXP_REPLACE(t, '\\x27[^\\x27]*\\x27', '', 'g'), 'COPY\\s+[A-Z0-9]+(?:\\s+(?:IN|OF)\\s+[A-Z0-9]+)?(?:\\s+REPLACING(?:\\s+==[^=]+==\\s+BY\\s+==[^=]+==)+)?\\s*\\.')) AS c FROM j),
 cp AS (SELECT file, REGEXP_EXTRACT(c, 'COPY\\s+([A-Z0-9]+)', 1) AS copybook, COALESCE(NULLIF(REGEXP_EXTRACT(c, '\\s(?:IN|OF)\\s+([A-Z0-9]+)', 1), ''), 'DEFAULT') AS library,
  REGEXP_REPLACE(REGEXP_EXTRACT(c, 'REPLACING\\s+(.*==)', 1, 's'), '\\s+', ' ', 'g') AS replacing FROM q)"""
NET_SQL = SPLIT_SQL + """,
 bk AS (SELECT CONCAT('LIB', CAST(SUBSTR(file, 4)::BIGINT // 6 % 2 AS STRING), '/', file) AS book, file, line_no, text FROM net_line),
 ed AS (SELECT book AS src, CONCAT(CASE WHEN x LIKE '%FAR%' THEN 'DEFAULT' ELSE REGEXP_EXTRACT(x, 'IN ([A-Z0-9]+)', 1) END, '/', REGEXP_EXTRACT(x, 'COPY ([A-Z0-9]+)', 1)) AS dst FROM (SELECT book, UNNEST(REGEXP_EXTRACT_ALL(text, 'COPY [^.]+')) AS x FROM bk)),
 full_ring AS (SELECT SUBSTR(file, 4)::BIGINT // 6 AS g, MIN(book) AS ring FROM (SELECT DISTINCT file, book FROM bk) GROUP BY 1 HAVING COUNT(*) = 6),
 ringed AS (SELECT DISTINCT book, ring FROM bk JOIN full_ring ON g = SUBSTR(file, 4)::BIGINT // 6)"""


@query("k3_split_copies", "split_line", f"WITH {SPLIT_SQL} SELECT file, copybook, library, replacing FROM cp")
def _(s):
    return copybooks.copy_statements(s("split_line")).select("file", "copybook", "library", "replacing")


def net_books(s):
    """Books in two libraries: six books of a ring are in the same one."""
    return s("net_line").withColumn("library", F.concat(F.lit("LIB"), F.expr("CAST(CAST(substring(file, 4) AS BIGINT) DIV 6 % 2 AS STRING)")))


@query("k4_library_closure", "split_line net_line", f"""WITH RECURSIVE {NET_SQL},
 r AS (SELECT DISTINCT CONCAT(library, '/', copybook) AS top, CONCAT(library, '/', copybook) AS node, 1 AS depth FROM cp UNION SELECT r.top, ed.dst, r.depth + 1 FROM r JOIN ed ON ed.src = r.node WHERE r.depth < 9),
 l AS (SELECT top, node, MIN(depth) AS depth FROM r GROUP BY top, node)
 SELECT cp.file, SPLIT_PART(node, '/', 1) AS library, SPLIT_PART(node, '/', 2) AS copybook, CAST(MIN(depth) AS BIGINT) AS depth,
  CASE WHEN node NOT IN (SELECT book FROM bk) THEN 'unresolved' WHEN node IN (SELECT book FROM ringed) THEN 'circular' ELSE 'resolved' END AS status
 FROM cp JOIN l ON l.top = CONCAT(cp.library, '/', cp.copybook) GROUP BY cp.file, node""")
def _(s):
    return copybooks.closure(s("split_line"), net_books(s)).select("file", "library", "copybook", "depth", "status")


@query("k4_rings", "split_line net_line", f"WITH {NET_SQL} SELECT book, ring FROM ringed")
def _(s):
    return copybooks.rings_of(copybooks.book_statements(net_books(s)))


@query("k5_library_expansion", "split_line net_line", f"""WITH RECURSIVE {NET_SQL},
 r AS (SELECT file AS program, CONCAT(library, '/', copybook) AS node, CONCAT('|', library, '/', copybook, '|') AS path, FALSE AS again FROM cp
  UNION ALL SELECT r.program, ed.dst, CONCAT(r.path, ed.dst, '|'), CONTAINS(r.path, CONCAT('|', ed.dst, '|')) FROM r JOIN ed ON ed.src = r.node WHERE NOT r.again)
 SELECT program AS file, COUNT(*) FILTER (NOT again AND node IN (SELECT book FROM bk)) AS books, COUNT(*) FILTER (again) AS circular, COUNT(*) FILTER (NOT again AND node NOT IN (SELECT book FROM bk)) AS unresolved FROM r GROUP BY program""")
def _(s):
    text = F.col("text")
    return copybooks.expand(s("split_line"), net_books(s)).groupBy("file").agg(
        F.count_if(text.startswith("      * >>>BEGIN COPY")).alias("books"), F.count_if(text.startswith("      * >>>CIRCULAR COPY")).alias("circular"), F.count_if(text.startswith("      * >>>UNRESOLVED COPY")).alias("unresolved")
    )


@query("h20_apply_replacing", sql="SELECT p_partkey, REGEXP_REPLACE(REGEXP_REPLACE(p_name, '\\bred\\b', 'scarlet', 'gi'), '\\bring\\b', 'band', 'gi') AS name FROM part")
def _(s):
    return s.table("part").select("p_partkey", tx.apply_replacing(F.col("p_name"), [("RED", "scarlet"), ("ring", "band")]).alias("name"))


@query("k6_data_items", SRC, f"WITH {ITEM_SQL} SELECT file, line_no, level, name, pic, usage, value, occurs, parent, kind FROM it")
def _(s):
    return estate.data_items(kept(s)).select("file", "line_no", "level", "name", "pic", "usage", "value", "occurs", "parent", "kind")


@query("k7_decode_pics", SRC, f"""WITH {ITEM_SQL} SELECT file, name, pic, CASE WHEN pic LIKE 'X%' THEN 'text' WHEN pic LIKE 'Z%' THEN 'edited' ELSE 'decimal' END AS pic_type,
 CAST(CASE WHEN pic = 'S9(9)V99' THEN 9 WHEN pic = '9(5)V9(2)' THEN 5 WHEN pic LIKE 'ZZ%' THEN 7 ELSE 0 END AS BIGINT) AS int_digits, CAST(CASE WHEN pic LIKE '%V%' THEN 2 ELSE 0 END AS BIGINT) AS dec_digits,
 pic LIKE 'S%' AS signed, CONTAINS(pic, 'V') AS implied_point, CAST(CASE WHEN pic = 'S9(9)V99' THEN 11 WHEN pic LIKE 'X(%' OR pic = 'X' THEN COALESCE(NULLIF(REGEXP_EXTRACT(pic, '\\((\\d+)\\)', 1), ''), '1')::BIGINT WHEN pic LIKE 'ZZ%' THEN 7 ELSE 7 END AS BIGINT) AS storage_len FROM it WHERE pic IS NOT NULL""")
def _(s):
    return estate.decode_pics(estate.data_items(kept(s))).drop("line_no")


@query("a5_implied_decimal", "loan", "SELECT loan_id, CAST(original_cents AS DOUBLE) / 100 AS amount, original_cents AS cents FROM loan")
def _(s):
    padded = s("loan").select("loan_id", F.lpad(F.col("original_cents").cast("string"), 13, "0").alias("t"))
    d = padded.select("loan_id", pic.implied_decimal(F.col("t")).alias("cents"))
    return d.select("loan_id", pic.as_decimal(F.col("cents"), 11, 2).cast("double").alias("amount"), "cents")


@query("a6_layout_from_copybook", SRC, f"""WITH {ITEM_SQL}, w AS (SELECT *, CASE WHEN pic = 'S9(9)V99' THEN 11 WHEN pic LIKE 'X(%' THEN REGEXP_EXTRACT(pic, '\\((\\d+)\\)', 1)::BIGINT WHEN pic = 'X' THEN 1 WHEN pic LIKE 'ZZ%' THEN 9 ELSE 7 END AS len FROM it WHERE pic IS NOT NULL AND level <> 88)
 SELECT file, name, CAST(SUM(len) OVER (PARTITION BY file ORDER BY line_no) - len AS BIGINT) AS "offset", CAST(len AS BIGINT) AS length FROM w""")
def _(s):
    return estate.layout_from_copybook(estate.data_items(kept(s))).select("file", "name", "offset", "length")


@query("k8_condition_values", SRC, f"WITH {ITEM_SQL} SELECT file, name, REPLACE(name, 'IS-ON', 'FLAG') AS owner, n AS value_no, CASE n WHEN 1 THEN 'Y' ELSE 'S' END AS value FROM (SELECT *, UNNEST(range(1, 3)) AS n FROM it WHERE level = 88)")
def _(s):
    c = kept(s)
    return estate.condition_values(c, estate.data_items(c)).drop("line_no")


@query("k10_call_edges", SRC, f"WITH {EDGE_SQL} SELECT file, line_no, src, dst, kind, conditional FROM ed")
def _(s):
    return estate.call_edges(kept(s)).select("file", "line_no", "src", "dst", "kind", "conditional")


@query("k11_external_calls", SRC, f"WITH {EDGE_SQL} SELECT file, dst AS program, COUNT(*) AS calls, STRING_AGG(DISTINCT CASE WHEN SPLIT_PART(using_list, ' ', 1) < SPLIT_PART(using_list, ' ', 2) THEN using_list ELSE CONCAT(SPLIT_PART(using_list, ' ', 2), ' ', SPLIT_PART(using_list, ' ', 1)) END, ' ') AS using_names FROM ed WHERE kind = 'CALL' GROUP BY file, dst")
def _(s):
    return estate.external_calls(estate.call_edges(kept(s)))


@query("k12_verb_counts", SRC, f"""WITH {CTX_SQL} SELECT file, paragraph, verb, COUNT(*) AS statements FROM (SELECT file, paragraph, RTRIM(SPLIT_PART(up, ' ', 1), '.') AS verb FROM st)
 WHERE verb IN ('PERFORM','IF','GO','CALL','STOP','ADD','MOVE','COMPUTE','EVALUATE','WHEN','DISPLAY','EXIT') AND paragraph IS NOT NULL GROUP BY file, paragraph, verb""")
def _(s):
    return estate.verb_counts(ctx(s))


BIND_SQL = CODE_SQL + """, bd AS (SELECT file, REGEXP_EXTRACT(up, '^SELECT (FILE-\\d+)', 1) AS name, REGEXP_EXTRACT(up, '''(DD\\d+)''', 1) AS assign_to, 'FD' AS fd_kind, REPLACE(REGEXP_EXTRACT(up, '^SELECT (FILE-\\d+)', 1), 'FILE', 'KEY') AS record_key, CAST(NULL AS STRING) AS alternate_key, TRUE AS indexed FROM co WHERE up LIKE 'SELECT FILE%'
  UNION ALL SELECT s.file, REGEXP_EXTRACT(s.up, '^SELECT (OUT-\\d+)', 1), REPLACE(REGEXP_EXTRACT(s.up, '(OUT-\\d+)', 1), 'OUT-', 'REPORT'), NULL, NULL, NULL, FALSE FROM co s WHERE s.up LIKE 'SELECT OUT%')"""


@query("k13_file_bindings", SRC, f"WITH {BIND_SQL} SELECT * FROM bd")
def _(s):
    return estate.file_bindings(estate.code_lines(s(SRC)))


@query("g2_missing_descriptions", SRC, f"WITH {BIND_SQL} SELECT file, name FROM bd WHERE fd_kind IS NULL")
def _(s):
    return estate.missing_descriptions(estate.file_bindings(estate.code_lines(s(SRC))))


@query("k18_dead_paragraphs", SRC, f"WITH {EDGE_SQL} SELECT file, paragraph, line_no FROM cx c WHERE para_line = line_no AND paragraph <> '0000-MAIN' AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.file = c.file AND ed.dst = c.paragraph)")
def _(s):
    c = kept(s)
    return estate.dead_paragraphs(estate.paragraphs(c), estate.call_edges(c))


@query("k19_unused_items", SRC, f"WITH {ITEM_SQL} SELECT file, name, line_no FROM it WHERE kind <> 'group' AND NOT EXISTS (SELECT 1 FROM cx WHERE cx.file = it.file AND division = 'PROCEDURE' AND REGEXP_MATCHES(CONCAT(' ', up, ' '), CONCAT('[^A-Z0-9-]', it.name, '[^A-Z0-9-]')))")
def _(s):
    c = kept(s)
    return estate.unused_items(estate.data_items(c), c)


# What each paragraph of the test programs reads and writes.
SYM_SQL = """sy AS (SELECT file, 'PGM' AS k, UNNEST([
  {'p': '0000-MAIN', 's': 'AMT-', 'a': 'R'}, {'p': '0000-MAIN', 's': 'FLAG-', 'a': 'R'}, {'p': '0000-MAIN', 's': 'REC-', 'a': 'R'}, {'p': '1000-WORK', 's': 'AMT-', 'a': 'W'}, {'p': '1000-WORK', 's': 'FLAG-', 'a': 'W'},
  {'p': '2000-LOOP', 's': 'AMT-', 'a': 'R'}, {'p': '2000-LOOP', 's': 'AMT-', 'a': 'W'}, {'p': '2000-LOOP', 's': 'FLAG-', 'a': 'R'}, {'p': '3000-CHECK', 's': 'NAME-', 'a': 'R'}]) AS u FROM (SELECT DISTINCT file FROM source_line)),
 sym AS (SELECT file, u.p AS paragraph, CONCAT(u.s, SUBSTR(file, 4)) AS symbol, u.a AS access FROM sy)"""


@query("k26_paragraph_symbols", SRC, f"WITH {SYM_SQL} SELECT file, paragraph, symbol, access FROM sym")
def _(s):
    c = kept(s)
    return estate.paragraph_symbols(c, estate.data_items(c))


@query("k19_write_only_items", SRC, f"WITH {SYM_SQL} SELECT file, symbol AS name FROM sym WHERE paragraph = '1000-WORK' AND symbol LIKE 'FLAG-%' AND FALSE")
def _(s):
    c = kept(s)
    items = estate.data_items(c)
    return estate.write_only_items(items, estate.paragraph_symbols(c, items))


@query("k20_structure_errors", SRC, f"WITH {BIND_SQL} SELECT file, 'missing description' AS error, name FROM bd WHERE fd_kind IS NULL")
def _(s):
    code = estate.code_lines(s(SRC))
    c = kept(s)
    return estate.structure_errors(c, estate.data_items(c), estate.file_bindings(code))


@query("k21_risk_flags", SRC, "SELECT DISTINCT file, TRUE AS arithmetic_expression, TRUE AS conditional_logic, TRUE AS loop_logic, TRUE AS goto_present, FALSE AS redefines_present, TRUE AS occurs_present, TRUE AS file_io_present, TRUE AS external_calls_present, TRUE AS nested_conditionals FROM source_line")
def _(s):
    code = estate.code_lines(s(SRC))
    c = kept(s)
    return estate.risk_flags(c, estate.data_items(c), estate.file_bindings(code), estate.call_edges(c), estate.control_points(c))


@query("k22_complexity_tier", SRC, f"SELECT file, COUNT(*) AS lines, {big(2)} AS files, {big(1)} AS copybooks, {big(1)} AS subprograms, FALSE AS has_sql, FALSE AS has_sort, TRUE AS has_indexed, {big(6)} AS score, 'Complex' AS tier FROM source_line GROUP BY file")
def _(s):
    lines = s(SRC)
    code = estate.code_lines(lines)
    c = kept(s)
    return estate.complexity_tier(lines, c, estate.file_bindings(code), copybooks.copy_statements(lines), estate.call_edges(c))


# 1000-WORK and 3000-CHECK have two PERFORM sites each, 2000-LOOP has one; 4000-EXIT is only the goal of a GO TO, which is no call.
SEG_SQL = """sg AS (SELECT file, u.p AS paragraph, u.g AS segment FROM (SELECT DISTINCT file, UNNEST([{'p': '0000-MAIN', 'g': '0000-MAIN'}, {'p': '1000-WORK', 'g': '1000-WORK'}, {'p': '2000-LOOP', 'g': '0000-MAIN'},
 {'p': '3000-CHECK', 'g': '3000-CHECK'}, {'p': '4000-EXIT', 'g': '4000-EXIT'}, {'p': '9000-DEAD', 'g': '9000-DEAD'}]) AS u FROM source_line))"""


def segs(c):
    pars = estate.paragraphs(c)
    return estate.segments(pars, estate.internal_calls(estate.call_edges(c), pars))


@query("k24_segments", SRC, f"WITH {SEG_SQL} SELECT * FROM sg")
def _(s):
    return segs(kept(s))


@query("k23_segment_complexity", SRC, f"""WITH {SEG_SQL} SELECT file, segment, COUNT(*) AS paragraphs, {big("MAX(CASE segment WHEN '0000-MAIN' THEN 1 ELSE 0 END)")} AS loops, {big("MAX(CASE segment WHEN '0000-MAIN' THEN 3 ELSE 0 END)")} AS branches,
 {big("MAX(CASE segment WHEN '0000-MAIN' THEN 11 WHEN '1000-WORK' THEN 3 ELSE 1 END)")} AS ops, {big("MAX(CASE segment WHEN '0000-MAIN' THEN 6 + 12 + 11 WHEN '1000-WORK' THEN 3 ELSE 1 END)")} AS score_x2,
 MAX(CASE segment WHEN '0000-MAIN' THEN 'medium' ELSE 'low' END) AS complexity FROM sg GROUP BY file, segment""")
def _(s):
    c = kept(s)
    return estate.segment_complexity(segs(c), estate.control_points(c), estate.verb_counts(c))


@query("d19_shared_symbols", SRC, f"WITH {SYM_SQL}, {SEG_SQL} SELECT sym.file, symbol, COUNT(DISTINCT segment) AS segments FROM sym JOIN sg ON sg.file = sym.file AND sg.paragraph = sym.paragraph GROUP BY sym.file, symbol HAVING COUNT(DISTINCT segment) > 1 AND BOOL_OR(access = 'W')")
def _(s):
    c = kept(s)
    return estate.shared_symbols(estate.paragraph_symbols(c, estate.data_items(c)), segs(c))


@query("k25_impact_slice", SRC, f"""WITH {EDGE_SQL}, ic AS (SELECT DISTINCT file, src, dst FROM ed WHERE kind = 'PERFORM'), tg AS (SELECT file, paragraph AS target FROM cx WHERE para_line = line_no),
 s0 AS (SELECT file, target, target AS paragraph, 0 AS r FROM tg UNION ALL SELECT tg.file, target, dst, 1 FROM tg JOIN ic ON ic.file = tg.file AND ic.src = tg.target UNION ALL SELECT tg.file, target, src, 2 FROM tg JOIN ic ON ic.file = tg.file AND ic.dst = tg.target UNION ALL SELECT file, target, '0000-MAIN', 3 FROM tg),
 s1 AS (SELECT file, target, paragraph, MIN(r) AS r FROM s0 GROUP BY file, target, paragraph)
 SELECT file, target, paragraph, CASE r WHEN 0 THEN 'target' WHEN 1 THEN 'callee' WHEN 2 THEN 'caller' ELSE 'entry' END AS role, COUNT(*) OVER (PARTITION BY file, target) AS slice_size, CASE WHEN COUNT(*) OVER (PARTITION BY file, target) > 4 THEN 'section' ELSE 'paragraph' END AS scope FROM s1""")
def _(s):
    c = kept(s)
    pars = estate.paragraphs(c)
    targets = pars.select("file", F.upper("paragraph").alias("target")).distinct()
    return estate.impact_slice(targets, estate.internal_calls(estate.call_edges(c), pars), pars)


@query("k27_boundary_cases", SRC, """WITH p AS (SELECT DISTINCT file, CAST(SUBSTR(file, 4) AS BIGINT) AS k FROM source_line), q AS (SELECT *, k % 12 + 3 AS n FROM p)
 SELECT file, 'OCCURS boundary' AS case_type, CAST(NULL AS STRING) AS paragraph, CONCAT('TAB-', CAST(k AS STRING)) AS field, CAST(n + UNNEST([-1, 0, 1]) AS STRING) AS case_value FROM q
 UNION ALL SELECT file, 'loop boundary', '0000-MAIN', 'PERFORM_UNTIL', CAST(n + UNNEST([-1, 0, 1]) AS STRING) FROM q
 UNION ALL SELECT file, 'EVALUATE threshold', '2000-LOOP', CONCAT('FLAG-', CAST(k AS STRING)), CAST(k + UNNEST([-1, 0, 1]) AS STRING) FROM q
 UNION ALL SELECT file, 'early exit', '4000-EXIT', 'EXIT_PARAGRAPH', 'early exit path' FROM q""")
def _(s):
    c = kept(s)
    return estate.boundary_cases(estate.data_items(c), cut(estate.control_points(c)), c)


@query("k28_structure_checks", SRC, f"""WITH {EDGE_SQL.replace('WITH ', '')}, {ITEM_SQL.split(' i0 AS')[1].join([' i0 AS', ''])}
 SELECT file, CONCAT('SYM_', name) AS check_id, 'critical' AS severity, TRUE AS passed FROM it UNION ALL SELECT file, CONCAT('CALL_', src, '_TO_', dst), 'critical', TRUE FROM ed WHERE kind = 'PERFORM'
 UNION ALL SELECT file, CONCAT('RESERVED_', paragraph), 'critical', TRUE FROM cx WHERE para_line = line_no""")
def _(s):
    c = kept(s)
    pars = estate.paragraphs(c)
    return estate.structure_checks(estate.data_items(c), estate.call_edges(c), pars)


# Long sources: all programs of a residue class as one file; 49 lines each.
def big_files(s):
    k = F.expr("CAST(substring(file, 4) AS BIGINT)")
    lines = s(SRC)
    group = F.pmod(k, F.lit(50))
    size = F.when(group < 10, 400).when(group < 30, 20).otherwise(1000000)
    return lines.where(F.call_function("div", k, F.lit(50)) < size).select(
        F.concat(F.lit("BIG"), group.cast("string")).alias("file"), (F.call_function("div", k, F.lit(50)) * NLINES + F.col("line_no")).cast("bigint").alias("line_no"), "text"
    )


BIG_SQL = f"""bf AS (SELECT CONCAT('BIG', CAST(k % 50 AS STRING)) AS file, k // 50 * {NLINES} + line_no AS line_no, text FROM (SELECT CAST(SUBSTR(file, 4) AS BIGINT) AS k, * FROM source_line) WHERE k // 50 < (CASE WHEN k % 50 < 10 THEN 400 WHEN k % 50 < 30 THEN 20 ELSE 1000000 END)),
 sz AS (SELECT file, MAX(line_no) AS n FROM bf GROUP BY file),
 ps AS (SELECT bf.file, line_no, sz.n FROM bf JOIN sz ON sz.file = bf.file WHERE sz.n > 1500 AND REGEXP_MATCHES(text, '^\\s{{0,7}}([A-Z0-9][A-Z0-9-]*)\\.\\s*$')),
 nx AS (SELECT p.file, p.line_no, p.n, (SELECT MIN(q.line_no) FROM ps q WHERE q.file = p.file AND q.line_no >= p.line_no + 120) AS nxt FROM ps p),
 op AS (SELECT nx.* FROM nx JOIN (SELECT file, MIN(line_no) AS f FROM ps GROUP BY file) z ON z.file = nx.file AND z.f = nx.line_no UNION ALL SELECT nx.* FROM op JOIN nx ON nx.file = op.file AND nx.line_no = op.nxt),
 sc AS (SELECT bf.file, bf.line_no, bf.text, SUM(CASE WHEN REGEXP_MATCHES(text, '(?i)^\\s{{0,7}}([A-Z0-9][A-Z0-9-]*)\\s+(DIVISION|SECTION)\\s*\\.?') AND line_no > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bf.file ORDER BY line_no) AS g FROM bf JOIN sz ON sz.file = bf.file WHERE sz.n > 600 AND sz.n <= 1500),
 ch AS (SELECT file, {big(1)} AS start_line, n AS end_line, 'whole_program' AS chunk_type FROM sz WHERE n <= 600
  UNION ALL SELECT file, MIN(line_no), MAX(line_no), 'section' FROM sc GROUP BY file, g
  UNION ALL SELECT file, GREATEST(line_no - 10, 1), CASE WHEN nxt IS NULL THEN n ELSE LEAST(nxt - 1 + 10, n) END, 'paragraph_block' FROM op)"""


@query("e11_chunk_lines", SRC, f"WITH RECURSIVE {BIG_SQL} SELECT * FROM ch")
def _(s):
    return estate.chunk_lines(big_files(s))


@query("k29_usable_chunks", SRC, f"""WITH RECURSIVE {BIG_SQL}, mk AS (SELECT file, line_no FROM bf WHERE REGEXP_MATCHES(UPPER(text), 'IF |EVALUATE|COMPUTE|CALL |MOVE |PERFORM|READ|WRITE|OPEN|CLOSE|INSPECT|STRING|UNSTRING|SORT|MERGE|PIC |OCCURS '))
 SELECT file, start_line, end_line, chunk_type, reason IS NULL AS usable, reason FROM (SELECT ch.*, CASE WHEN end_line - start_line + 1 < 5 THEN 'too_few_lines' WHEN NOT EXISTS (SELECT 1 FROM mk WHERE mk.file = ch.file AND mk.line_no BETWEEN start_line AND end_line) THEN 'no_business_or_data_markers' END AS reason FROM ch)""")
def _(s):
    lines = cut(big_files(s))
    return estate.usable_chunks(estate.chunk_lines(lines), lines)


@query("f6_project_order", "source_line book_line", f"""WITH al AS (SELECT * FROM source_line UNION ALL SELECT * FROM book_line), {COPY_SQL.format(t='al')} SELECT file, file IN (SELECT copybook FROM cp) AS referenced FROM (SELECT DISTINCT file FROM al)""")
def _(s):
    return estate.project_order(s(SRC).unionByName(s("book_line")))


@query("d23_project_complexity", "run", """WITH r AS (SELECT program, CASE run_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE CASE WHEN run_id % 8 = 3 THEN 2 ELSE 3 END END AS k FROM run)
 SELECT program, CASE WHEN MIN(k) IS NULL THEN 'Unknown' WHEN MIN(k) <> MAX(k) THEN 'Mixed' WHEN MIN(k) = 1 THEN 'Simple' WHEN MIN(k) = 2 THEN 'Medium' ELSE 'Complex' END AS complexity FROM r GROUP BY program""")
def _(s):
    m = F.col("run_id") % 4
    label = F.when(m == 0, "Low").when(m == 1, " simple").when(m == 2, "n/a").when(F.col("run_id") % 8 == 3, "medium").otherwise("HIGH")
    return estate.project_complexity(s("run").withColumn("label", label), "program", "label")


@query("h17_boundary_values", "base_line", """SELECT line_no, CASE line_no % 4 WHEN 0 THEN 'capacity' WHEN 1 THEN 'threshold_below' WHEN 2 THEN 'overtime' ELSE 'generic_numeric' END AS kind,
 CAST(CASE line_no % 4 WHEN 2 THEN 40 ELSE line_no END AS BIGINT) AS threshold, CASE line_no % 4 WHEN 2 THEN '40,41' ELSE CONCAT(CAST(line_no - 1 AS STRING), ',', CAST(line_no AS STRING), ',', CAST(line_no + 1 AS STRING)) END AS edge_values FROM base_line""")
def _(s):
    n, m = F.col("line_no").cast("string"), F.col("line_no") % 4
    rule = (
        F.when(m == 0, F.concat(F.lit("Limited to "), n, F.lit(" rows"))).when(m == 1, F.concat(F.lit("Amounts below "), n, F.lit(" are free")))
        .when(m == 2, F.concat(F.lit("Overtime over "), n)).otherwise(F.concat(F.lit("Row "), n, F.lit(" is kept")))
    )
    kind, t, v = tx.boundary_rule(F.col("rule"))
    return s("base_line").select("line_no", rule.alias("rule")).select("line_no", kind.alias("kind"), t.alias("threshold"), v.alias("edge_values"))


@query("h18_condition_threshold", "base_line", "SELECT line_no, CASE WHEN line_no % 3 = 2 THEN NULL ELSE line_no END AS threshold FROM base_line")
def _(s):
    n, m = F.col("line_no").cast("string"), F.col("line_no") % 3
    c = F.when(m == 0, F.concat(F.lit("WS-A1 > "), n)).when(m == 1, F.concat(F.lit("X = "), n)).otherwise("TRUE")
    return s("base_line").select("line_no", tx.condition_threshold(c).alias("threshold"))


# --- job control -------------------------------------------------------------

DK = "deck_line"
DECK = "d AS (SELECT DISTINCT file, CAST(SUBSTR(file, 4) AS BIGINT) AS k FROM deck_line)"


def stmts(s):
    return jcl.statements(s(DK))


@query("e7_join_continuations", DK, f"""WITH {DECK} SELECT file, {big('n')} AS line_no, text FROM (
 SELECT file, 1 AS n, CONCAT('//JOB', CAST(k AS STRING), '   JOB (ACCT),''BATCH'', CLASS=A') AS text FROM d UNION ALL SELECT file, 4, CONCAT('//STEP01   EXEC PGM=PGM', CAST(k * 2 AS STRING), ', COND=(0,NE),PARM=''MODE=', CAST(k AS STRING), '''') FROM d
 UNION ALL SELECT file, 9, CONCAT('//OUT1     DD  DSN=DATA.SET', CAST(CASE WHEN k % 10 = 9 THEN k ELSE k + 1 END AS STRING), ', DISP=(NEW,CATLG,DELETE)') FROM d
 UNION ALL SELECT file, line_no, RTRIM(text) FROM deck_line WHERE line_no IN (6, 7, 8, 11, 12, 13, 14, 15))""")
def _(s):
    return stmts(s)


@query("k14_jcl_steps", DK, f"""WITH {DECK} SELECT file, CONCAT('JOB', CAST(k AS STRING)) AS job, u.s AS step, CASE u.s WHEN 'STEP01' THEN CONCAT('PGM', CAST(k * 2 AS STRING)) WHEN 'STEP02' THEN CONCAT('PGM', CAST(k * 2 + 1 AS STRING)) END AS program, CASE u.s WHEN 'STEP03' THEN 'MYPROC' END AS procedure,
 CASE u.s WHEN 'STEP01' THEN CONCAT('MODE=', CAST(k AS STRING)) END AS parm, {big("u.r")} AS cond_rc, u.o AS cond_op, u.t AS cond_step
 FROM (SELECT *, UNNEST([{{'s': 'STEP01', 'r': 0, 'o': 'NE', 't': NULL}}, {{'s': 'STEP02', 'r': 4, 'o': 'LT', 't': 'STEP01'}}, {{'s': 'STEP03', 'r': 8, 'o': 'EQ', 't': NULL}}]) AS u FROM d)""")
def _(s):
    return jcl.jcl_steps(stmts(s)).drop("line_no")


DD_SQL = DECK + """, dd AS (SELECT file, 'STEP01' AS step, 'SYSLIB' AS dd, 'LIB.COPY' AS dataset, 'SHR' AS disposition, FALSE AS concatenated FROM d
 UNION ALL SELECT file, 'STEP01', 'IN1', CONCAT('DATA.SET', CAST(k AS STRING)), 'SHR', FALSE FROM d UNION ALL SELECT file, 'STEP01', 'IN1', CONCAT('DATA.EXTRA', CAST(k AS STRING)), 'SHR', TRUE FROM d
 UNION ALL SELECT file, 'STEP01', 'OUT1', CONCAT('DATA.SET', CAST(CASE WHEN k % 10 = 9 THEN k ELSE k + 1 END AS STRING)), 'NEW,CATLG,DELETE', FALSE FROM d
 UNION ALL SELECT file, 'STEP02', CONCAT('DD', CAST((k * 2 + 1) % 20 AS STRING)), CONCAT('MASTER.M', CAST((k * 2 + 1) % 20 AS STRING)), 'MOD,KEEP', FALSE FROM d
 UNION ALL SELECT file, 'STEP02', 'LOG', NULL, NULL, FALSE FROM d UNION ALL SELECT file, 'STEP03', 'SYSIN', NULL, NULL, FALSE FROM d)"""


@query("k15_jcl_dd", DK, f"WITH {DD_SQL} SELECT file, step, dd, dataset, disposition, concatenated, dd = 'SYSLIB' AS copy_library FROM dd")
def _(s):
    return jcl.jcl_dd(stmts(s)).select("file", "step", "dd", "dataset", "disposition", "concatenated", "copy_library")


@query("k16_step_runs", DK, f"""WITH {DECK}, r AS (SELECT *, k % 3 * 4 AS rc1, k % 5 * 4 AS rc2 FROM d)
 SELECT file, 'STEP01' AS step, CONCAT('PGM', CAST(k * 2 AS STRING)) AS program, TRUE AS runs FROM r UNION ALL SELECT file, 'STEP02', CONCAT('PGM', CAST(k * 2 + 1 AS STRING)), NOT 4 < rc1 FROM r UNION ALL SELECT file, 'STEP03', NULL, NOT (rc1 = 8 OR rc2 = 8) FROM r""")
def _(s):
    steps = jcl.jcl_steps(stmts(s))
    k = F.expr("CAST(substring(file, 4) AS BIGINT)")
    rc = steps.where("step <> 'STEP03'").select("file", "step", F.when(F.col("step") == "STEP01", k % 3 * 4).otherwise(k % 5 * 4).alias("rc"))
    return jcl.step_runs(steps, rc)


@query("c14_bind_files", "source_line deck_line", f"""WITH {CODE_SQL}, {DD_SQL}, b AS (SELECT file AS program, REGEXP_EXTRACT(up, '^SELECT (FILE-\\d+)', 1) AS name, REGEXP_EXTRACT(up, '''(DD\\d+)''', 1) AS a FROM co WHERE up LIKE 'SELECT FILE%'
  UNION ALL SELECT file, REGEXP_EXTRACT(up, '^SELECT (OUT-\\d+)', 1), REPLACE(REGEXP_EXTRACT(up, '(OUT-\\d+)', 1), 'OUT-', 'REPORT') FROM co WHERE up LIKE 'SELECT OUT%'),
 s AS (SELECT CONCAT('PGM', CAST(k * 2 AS STRING)) AS program, file, 'STEP01' AS step FROM d UNION ALL SELECT CONCAT('PGM', CAST(k * 2 + 1 AS STRING)), file, 'STEP02' FROM d)
 SELECT b.program, b.name, b.a AS dd, COALESCE(dd.dataset, 'UNKNOWN') AS dataset, COALESCE(dd.disposition, 'UNKNOWN') AS disposition FROM b LEFT JOIN s ON s.program = b.program LEFT JOIN dd ON dd.file = s.file AND dd.step = s.step AND dd.dd = b.a AND NOT dd.concatenated""")
def _(s):
    st = stmts(s)
    b = estate.file_bindings(estate.code_lines(s(SRC))).select(F.col("file").alias("program"), "name", "assign_to")
    return jcl.bind_files(b, jcl.jcl_dd(st), jcl.jcl_steps(st))


@query("k17_data_lineage", DK, f"""WITH RECURSIVE {DD_SQL}, e AS (SELECT file, step, dataset AS ds, disposition NOT LIKE 'NEW%' AS rd, disposition LIKE 'NEW%' OR disposition LIKE 'MOD%' AS wr FROM dd WHERE dataset IS NOT NULL AND dd <> 'SYSLIB'),
 h AS (SELECT DISTINCT a.ds AS source, b.ds AS target FROM e a JOIN e b ON b.file = a.file AND b.step = a.step AND b.wr WHERE a.rd),
 r AS (SELECT source, target, 1 AS hops FROM h UNION SELECT r.source, h.target, r.hops + 1 FROM r JOIN h ON h.source = r.target WHERE r.hops < 10)
 SELECT source, target, CAST(MIN(hops) AS BIGINT) AS hops FROM r GROUP BY source, target""")
def _(s):
    st = cut(stmts(s))
    return jcl.data_lineage(jcl.lineage_edges(jcl.jcl_dd(st), jcl.jcl_steps(st)))
