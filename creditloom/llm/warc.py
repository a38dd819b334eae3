"""WARC archives: writing pages with revisits, and reading records back along a verified chain of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.session import cut, scratch_path

#: Every record starts with it; one digit of the version follows.  No part of it starts anew inside it, so readers of
#: different byte ranges find the same places.
MAGIC = "WARC/1."
BLANK = "\r\n\r\n"
STEP = len(MAGIC)


def _lines(*lines: str | Column) -> Column:
    return F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _named(name: str, value: Column) -> Column:
    """A header line; control characters are percent-encoded, so a value cannot start a line of its own."""
    clean = value.cast("string")
    for code in (*range(32), 127):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(F.lit(f"{name}: "), clean)


def deal_types(spark: SparkSession, pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages as ``page_id, url, payload`` with ``digest`` and ``original`` (the page that a revisit refers to, else null).

    Only groups of equal payloads are shuffled, as digests, summed per task; the few numbers of groups with more than
    one page are written, so the planner knows their true size when it joins them to the payloads.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.xxhash64("payload").alias("_second"))
    long = F.octet_length("payload") >= least_bytes
    path = scratch_path(spark, "warc-groups")
    rows.where(long).groupBy("digest", "_second").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n").write.parquet(path)
    groups = spark.read.parquet(path).withColumn("_long", F.lit(True))
    joined = rows.withColumn("_long", long).join(groups, ["digest", "_second", "_long"], "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("page_id", "url", "payload", "digest", original.alias("original"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (``page_id, url, html``) into archives under ``path``, one per task.

    Among rows with equal payloads of at least ``least_bytes`` bytes, those with the largest ``page_id`` are responses and the
    others are revisits that refer to it and hold no payload; smaller payloads are always responses.  A null ``html`` is
    empty; a null ``page_id`` sorts below all others and is written as an empty id; a null ``url`` is empty.  Repeated
    rows give repeated records.  Other columns are ignored; no rows give no records.  Archives are not compressed, so
    that readers can start anywhere.
    """
    rows = deal_types(pages.sparkSession, pages, least_bytes)
    revisit = F.col("original").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(BLANK))
    content = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = _lines(
        f"{MAGIC}1",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        _named("WARC-Target-URI", F.coalesce("url", F.lit(""))),
        F.lit(f"WARC-Date: {date}"),
        _named("WARC-Record-ID", ident(F.col("page_id"))),
        F.when(revisit, _lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", _named("WARC-Refers-To", ident(F.col("original"))))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
    )
    # The text writer ends each value with the blank lines that end a record.
    rows.select(F.concat(head, F.lit(BLANK), content).alias("value")).write.option("lineSep", BLANK).text(path)


def _field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    line = rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)"
    return F.when(F.regexp_like(header, F.lit(line)), F.trim(F.regexp_extract(header, line, 1)))


def _after(data: Column, skipped: Column, size: Column) -> Column:
    """``size`` bytes after the first ``skipped`` ones."""
    return F.substring(data.cast("binary"), (skipped + 1).cast("int"), size.cast("int"))


def _described(df: DataFrame, text: str, known: Column) -> DataFrame:
    """Adds size and digest of the payload inside the record text ``text`` where ``known``: what follows the HTTP header."""
    block = _after(F.col(text), F.col("head_bytes") + 4, F.col("content_bytes")).cast("string")
    http = F.octet_length(F.substring_index(F.col("_block"), BLANK, 1)) + 4
    is_http = F.coalesce(_field(F.col("header"), "Content-Type"), F.lit("")).startswith("application/http")
    skipped = F.when(is_http, F.least(http, F.octet_length("_block"))).otherwise(0)
    payload = _after(F.col("_block"), skipped, F.octet_length("_block") - skipped)
    out = df.withColumn("_block", F.when(known, block)).withColumn("_payload", payload)
    return out.withColumns({"payload_bytes": F.octet_length("_payload").cast("bigint"), "payload_sha1": F.sha1("_payload")}).drop("_block")


def _pieces(spark: SparkSession, paths: list[str], bodies: bool) -> DataFrame:
    """What stands between two occurrences of the magic, as a written table.

    ``path, block, seq`` tell the place: the byte range of the task that found it, and the order there.  A piece that
    looks like a record has ``header``, ``head_bytes`` and ``content_bytes``; one that also ends where it says has the
    description of its payload.  ``body`` is the piece itself, only if ``bodies``.
    """
    raw = spark.read.option("lineSep", MAGIC).text(paths)
    found = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
        F.octet_length("value").cast("bigint").alias("bytes"), F.substring_index("value", BLANK, 1).alias("_head"), "value",
    )
    # A version digit and a line end first, a blank line behind, and a length between.
    shaped = F.substring("_head", 2, 2).eqNullSafe("\r\n") & (F.octet_length("_head") + 4 <= F.col("bytes"))
    header = F.when(shaped, F.col("_head"))
    found = found.withColumn("header", header).withColumn("content_bytes", F.regexp_extract(F.col("header"), r"(?i)\r\nContent-Length:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", 1))
    found = found.withColumn("content_bytes", F.nullif(F.col("content_bytes"), F.lit("")).cast("bigint"))
    found = found.withColumn("header", F.when(F.col("content_bytes").isNotNull(), F.col("header"))).withColumn("head_bytes", F.octet_length("header").cast("bigint"))
    whole = F.coalesce(F.col("head_bytes") + 4 + F.col("content_bytes") + 4 == F.col("bytes"), F.lit(False))
    told = _described(found, "value", whole)
    path = scratch_path(spark, "warc-pieces")
    told.select(
        "path", "block", "seq", "bytes", "header", "head_bytes", "content_bytes", "payload_bytes", "payload_sha1", *([F.col("value").alias("body")] if bodies else [])
    ).write.parquet(path)
    return spark.read.parquet(path)


def _placed(pieces: DataFrame) -> DataFrame:
    """Light columns with ``at`` (offset of the piece, behind its magic), ``next`` (offset behind the magic of its successor, null if
    it is no record) and ``file_bytes``.  Offsets are running sums inside a byte range plus the totals of earlier ones."""
    light = pieces.select("path", "block", "seq", "bytes", "head_bytes", "content_bytes")
    step = F.col("bytes") + STEP
    totals = light.groupBy("path", "block").agg(F.sum(step).alias("_total"))
    before = Window.partitionBy("path").orderBy("block")
    carry = totals.select(
        "path", "block", F.coalesce(F.sum("_total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"),
        (F.sum("_total").over(Window.partitionBy("path")) - STEP).alias("file_bytes"),
    )
    inside = Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rel = light.withColumn("_rel", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    at = F.col("_carry") + F.col("_rel")
    return cut(
        rel.join(carry, ["path", "block"]).select(
            "path", "block", "seq", "bytes", at.alias("at"), (at + F.col("head_bytes") + 4 + F.col("content_bytes") + 4 + STEP).alias("next"), "file_bytes"
        )
    )


def _chained(placed: DataFrame) -> DataFrame:
    """Places of the records that the chain of boundaries reaches from the start of their file: ``path, block, seq, at, next``.

    Candidates that follow each other inside a byte range form runs, which are entered somewhere and left at their
    end; so the graph holds only places where a run is entered, and its pointers are doubled until nothing is reached.
    """
    candidates = placed.where(F.col("next").isNotNull() & (F.col("at") >= STEP)).select("path", "block", "seq", "at", "next")
    inside = Window.partitionBy("path", "block").orderBy("at")
    ends = F.coalesce(F.lead("at").over(inside) != F.col("next"), F.lit(True))
    runs = candidates.withColumn("_ends", ends.cast("bigint")).withColumn(
        "run", F.coalesce(F.sum("_ends").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    runs = cut(runs.drop("_ends"))
    exits = runs.groupBy("path", "block", "run").agg(F.max("next").alias("exit"))
    entered = exits.select("path", F.col("exit").alias("at")).distinct()
    doors = runs.join(entered, ["path", "at"], "left_semi").unionByName(runs.where(F.col("at") == STEP)).select("path", "block", "run", "at").distinct()
    doors = cut(doors.join(exits, ["path", "block", "run"]))
    jump = doors.select("path", "at", F.col("exit").alias("to"))
    jump = cut(jump.join(jump.select("path", F.col("at").alias("to")), ["path", "to"], "left_semi"))
    reached = new = doors.where(F.col("at") == STEP).select("path", "at")
    while True:  # the chain only runs forwards, so the pointers run out
        new = cut(reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at")))
        if new.isEmpty():
            break
        reached = cut(reached.unionByName(new).distinct())
        far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = cut(jump.join(far, ["path", "to"]).select("path", "at", F.col("_far").alias("to")))
    first = doors.join(reached, ["path", "at"], "left_semi").select("path", "block", "run", F.col("at").alias("_from"))
    return cut(runs.join(first, ["path", "block", "run"]).where(F.col("at") >= F.col("_from")).select("path", "block", "seq", "at", "next"))


def _parsed(records: DataFrame, payload: bool) -> DataFrame:
    """Named columns from the header and the place of each record."""
    h = F.col("header")
    urn = lambda name: F.regexp_replace(_field(h, name), "^<|>$", "")
    return records.select(
        "path", (F.col("at") - STEP).alias("offset"), (F.col("next") - STEP).alias("end"), _field(h, "WARC-Type").alias("record_type"),
        urn("WARC-Record-ID").alias("record_id"), urn("WARC-Refers-To").alias("refers_to"), _field(h, "WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(_field(h, "WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"), "payload_bytes", "payload_sha1",
        (F.col("next") - STEP <= F.col("file_bytes")).alias("complete"), *([F.col("_payload").alias("payload")] if payload else []),
    )


def _assembled(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of ``paths`` with whole payloads: pieces that the chain passed over belong to the record before them."""
    pieces = _pieces(spark, paths, True)
    placed = _placed(pieces)
    kept = _chained(placed)
    marked = placed.join(kept.select("path", "block", "seq", F.lit(True).alias("_kept")), ["path", "block", "seq"], "left")
    own = F.when(F.col("_kept"), F.col("at"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    here = marked.withColumn("_own", F.last(own, ignorenulls=True).over(inside))
    last = marked.groupBy("path", "block").agg(F.max(own).alias("_last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("path", "block", F.max("_last").over(before).alias("_carry"))
    owned = here.join(carry, ["path", "block"]).select("path", "block", "seq", "at", "next", "file_bytes", "_kept", "bytes", F.coalesce("_own", "_carry").alias("owner"))
    # A piece behind the end of its owner is no part of it: the chain broke there.
    ends = kept.select("path", F.col("at").alias("owner"), F.col("next").alias("_end"))
    owned = cut(owned.join(ends, ["path", "owner"]).where(F.col("at") < F.col("_end")).withColumn("_single", F.col("_kept") & (F.col("at") + F.col("bytes") >= F.least("_end", "file_bytes") - STEP)))
    bodies = pieces.select("path", "block", "seq", "header", "head_bytes", "content_bytes", "body").join(owned, ["path", "block", "seq"])
    columns = ["path", "at", "next", "file_bytes", "header", "head_bytes", "content_bytes", "body"]
    alone = bodies.where(F.coalesce("_single", F.lit(False))).select(*columns)
    rest = bodies.where(~F.coalesce("_single", F.lit(False)))
    parts = rest.groupBy("path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "body"))).alias("_parts"),  # one record, which becomes one value
        *[F.max(F.when(F.col("_kept"), F.col(c))).alias(c) for c in ("next", "file_bytes", "header", "head_bytes", "content_bytes")],
    )
    joined = parts.select("path", F.col("owner").alias("at"), "next", "file_bytes", "header", "head_bytes", "content_bytes", F.array_join(F.transform("_parts", lambda p: p["body"]), MAGIC).alias("body"))
    return _described(alone.unionByName(joined), "body", F.lit(True))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the uncompressed archives under ``path``, told apart by the chain of their boundaries.

    Tasks read byte ranges and emit every occurrence of the magic that looks like a record, with the offset at which
    its stated length lets the next record begin.  Only what the chain from the start of the file reaches is a record;
    magic inside a payload is none, and the pieces it makes are put together again.  A file that does not start with a
    record has none; behind a wrong length the chain ends, and what follows is not read.

    Returns ``path, offset, end, record_type, record_id, refers_to, target_uri, stated_digest,
    payload_bytes, payload_sha1, complete`` (false for a record that its file cuts short) and, with ``payloads``,
    ``payload`` (bytes).  Without it no payload is shuffled or written, but for archives that hold magic inside payloads.
    """
    if payloads:
        return _parsed(_assembled(spark, [path]), True)
    pieces = _pieces(spark, [path], False)
    placed = _placed(pieces)
    kept = _chained(placed)
    counts = placed.groupBy("path").agg(F.count_if(F.col("at") >= STEP).alias("_pieces"))
    counts = counts.join(kept.groupBy("path").agg(F.count("*").alias("_records")), "path")
    mixed = cut(counts.where("_pieces > _records").select("path"))
    plain = kept.join(placed.select("path", "block", "seq", "file_bytes"), ["path", "block", "seq"]).join(mixed, "path", "left_anti")
    # Records of plain files are single pieces; only a last one may be cut short, and has no description then.
    told = pieces.join(plain, ["path", "block", "seq"])
    out = _parsed(told, False)
    again = [r["path"] for r in mixed.collect()]  # names of files, as the driver lists them anyway
    return out.unionByName(_parsed(_assembled(spark, again), False)) if again else out


def with_originals(records: DataFrame) -> DataFrame:
    """Records with ``full_bytes`` and ``full_sha1``: those of the payload, or for a revisit those of the response it refers to.

    A revisit's response has the id it names and the digest it states; null if there is none.  The responses are cut
    before the join, so that the planner can split the many revisits of one response.
    """
    key = ["refers_to", "stated_digest"]
    whole = records.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to"), F.col("payload_sha1").alias("stated_digest"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_sha1").alias("full_sha1")
    )
    named = cut(whole.where(F.col("refers_to").isNotNull()).distinct())
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    joined = records.where(revisit).join(named, key, "left").select(*records.columns, "full_bytes", "full_sha1")
    return records.where(~revisit).withColumns({"full_bytes": F.col("payload_bytes"), "full_sha1": F.col("payload_sha1")}).unionByName(joined)


def archived_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads them back: the columns of ``read_warc`` and ``with_originals``, and
    ``page_id`` and ``original_id`` from the record ids."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind)
    out = with_originals(cut(read_warc(spark, path, payloads=False)))
    return out.withColumns({"page_id": page("record_id"), "original_id": page("refers_to")})
