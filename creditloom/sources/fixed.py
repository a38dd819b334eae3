"""Fixed-width tables: text lines and unterminated binary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import pic
from creditloom.sources.layouts import Field, width


def _decode(piece: Column, field: Field) -> Column:
    if field.kind == "x":
        return F.rtrim(piece)
    if field.kind == "9":
        return pic.implied_decimal(piece)
    raise ValueError(f"field {field.name}: kind {field.kind!r} needs binary records")


def _columns(fields: list[Field], decode) -> list[Column]:
    """Flat and nested (``group.item``) columns in layout order."""
    out: list[Column] = []
    groups: dict[str, list[Column]] = {}
    order: list[tuple[str, Column | None]] = []
    offset = 0
    for f in fields:
        if f.kind != "-":
            col = decode(f, offset)
            if "." in f.name:
                group, item = f.name.split(".")
                if group not in groups:
                    order.append((group, None))
                groups.setdefault(group, []).append(col.alias(item))
            else:
                order.append((f.name, col))
        offset += f.width
    for name, col in order:
        out.append((F.struct(*groups[name]) if col is None else col).alias(name))
    return out


def decode_lines(lines: DataFrame, fields: list[Field]) -> DataFrame:
    """Column ``value`` holding one record per row, to typed columns."""
    return lines.select(*_columns(fields, lambda f, off: _decode(F.substring("value", off + 1, f.width), f)))


def read_fixed(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """Newline-delimited fixed-width text; splittable."""
    return decode_lines(spark.read.text(path), fields)


def decode_records(records: DataFrame, fields: list[Field]) -> DataFrame:
    """Column ``record`` holding bytes, to typed columns (packed fields allowed)."""

    def decode(f: Field, off: int) -> Column:
        piece = F.substring("record", off + 1, f.width)
        if f.kind == "p":
            return pic.unpack_comp3(piece)
        return _decode(piece.cast("string"), f)

    return records.select(*_columns(fields, decode))


def read_fixed_binary(spark: SparkSession, path: str, fields: list[Field], reclen: int | None = None) -> DataFrame:
    """Unterminated records of ``reclen`` bytes, split at record borders.

    ``binaryRecords`` is the one splittable source of such files, so this is
    the one place that starts from an RDD.
    """
    raw = spark.sparkContext.binaryRecords(path, reclen or width(fields))
    records = spark.createDataFrame(raw.map(lambda b: (bytearray(b),)), "record binary")
    return decode_records(records, fields)


def encode_field(col: Column, field: Field) -> Column:
    if field.kind == "x":
        return F.rpad(F.coalesce(col.cast("string"), F.lit("")), field.width, " ")
    if field.kind == "9":
        return pic.zoned(F.coalesce(col.cast("bigint"), F.lit(0)), field.width)
    raise ValueError(f"field {field.name}: kind {field.kind!r} has no text form")


def overflows(df: DataFrame, fields: list[Field]) -> Column:
    """Names of the fields of a row whose values the layout cannot hold.

    These are texts longer than the field (blanks at the end aside), numbers with more digits, and negative numbers in
    fields without sign.  Nulls and columns that ``df`` lacks always fit.
    """
    have, found = set(df.columns), []
    for f in fields:
        if f.kind == "-" or f.name.split(".")[0] not in have:
            continue
        col = F.col(f.name)
        if f.kind == "x":
            bad = F.length(F.rtrim(col.cast("string"))) > f.width
        else:
            digits = f.width * 2 - 1 if f.kind == "p" else f.width
            number = col.cast("decimal(20,0)")
            bad = F.lit(False) if f.kind == "p" else number < 0
            if digits < 19:  # a BIGINT has no more
                bad = bad | (F.abs(number) >= F.lit(10**digits))
        found.append(F.when(bad, F.lit(f.name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def split_overflows(df: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """Rows that the layout holds, and the others with their fields in ``overflow_fields``."""
    marked = df.withColumn("overflow_fields", overflows(df, fields))
    fits = F.size("overflow_fields") == 0
    return marked.where(fits).drop("overflow_fields"), marked.where(~fits)


def _checked(df: DataFrame, fields: list[Field], record: Column, mode: str) -> Column:
    """Literal mode cuts what does not fit, as the batch does; clean mode ends the job and names the fields."""
    if pic.check_mode(mode) == pic.LITERAL:
        return record
    bad = overflows(df, fields)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("values too wide for fields: "), F.array_join(bad, ", ")))).otherwise(record)


def encode_lines(df: DataFrame, fields: list[Field], keep: list[str] | None = None, mode: str = pic.LITERAL) -> DataFrame:
    """Typed columns to one text ``value`` per row; absent columns are blank or zero."""
    have = set(df.columns)
    parts = []
    for f in fields:
        if f.kind == "-":
            parts.append(F.lit(" " * f.width))
        elif f.name.split(".")[0] in have:
            parts.append(encode_field(F.col(f.name), f))
        else:
            parts.append(F.lit(("0" if f.kind == "9" else " ") * f.width))
    return df.select(*(keep or []), _checked(df, fields, F.concat(*parts), mode).alias("value"))


def encode_records(df: DataFrame, fields: list[Field], mode: str = pic.LITERAL) -> DataFrame:
    """Typed columns to one binary ``record`` per row."""
    parts = []
    for f in fields:
        if f.kind == "p":
            parts.append(pic.pack_comp3(F.col(f.name), f.width * 2 - 1))
        else:
            text = F.lit(" " * f.width) if f.kind == "-" else encode_field(F.col(f.name), f)
            parts.append(F.encode(text, "UTF-8"))
    return df.select(_checked(df, fields, F.concat(*parts), mode).alias("record"))


def redelimit(lines: DataFrame, reclen: int) -> DataFrame:
    """Pad or cut every line to exactly ``reclen`` characters."""
    return lines.select(F.rpad(F.substring("value", 1, reclen), reclen, " ").alias("value"))


def join_records(lines: DataFrame, reclen: int, path: str) -> None:
    """Write lines as unterminated records of ``reclen`` characters.

    The text sink needs a separator, so the last character of the record, a
    blank filler in every layout that is stored this way, is the separator.
    """
    cut_lines = redelimit(lines, reclen)
    body = cut_lines.select(
        F.when(F.right("value", F.lit(1)) == " ", F.substring("value", 1, reclen - 1))
        .otherwise(F.raise_error(F.lit("record does not end with a blank filler")))
        .alias("value")
    )
    body.write.mode("overwrite").option("lineSep", " ").text(path)


def write_fixed(df: DataFrame, fields: list[Field], path: str, order: list[str] | None = None, mode: str = pic.LITERAL) -> None:
    """Write fixed-width lines; with ``order``, file-name order is row order.  Clean mode refuses values wider than their field."""
    if order:
        df = df.orderBy(*order)
    encode_lines(df, fields, mode=mode).write.mode("overwrite").text(path)


def file_manifest(spark: SparkSession, path: str, reclen: int | None = None) -> DataFrame:
    """md5, size and record count per file.

    Files above the 2 GB limit of one binary value get size and count only.
    """
    files = spark.read.format("binaryFile").load(path)
    size = F.col("length").cast("bigint")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.md5("content").alias("md5"),
        size.alias("size_bytes"),
        (pic.idiv(size, reclen) if reclen else F.lit(None).cast("bigint")).alias("record_count"),
    )
