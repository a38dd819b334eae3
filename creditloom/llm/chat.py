"""Chat formatting: typed content parts, escaped texts, a loss mask, and reading back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Placeholders of attachments; texts cannot hold them because ``<`` is escaped there.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """No ``<`` is left, so no control string can arise, also not where parts meet; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """As ``escape``, without line ends: the first one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A one-part content holding ``text``."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast(f"array<struct<type:string,text:string>>")


def _whole(parts: DataFrame, column: str) -> Column:
    """Parts with all fields of ``PART``; missing ones are null."""
    have = {f.name: f.dataType.simpleString() for f in parts.schema[column].dataType.elementType.fields}
    fields = [x.split(":") for x in PART[len("struct<") : -1].split(",")]
    return F.transform(
        F.coalesce(F.col(column), F.array().cast(parts.schema[column].dataType)),
        lambda p: F.struct(*[(p[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]),
    )


def expanded_tokens(part: Column, patch: int = 28, audio_rate: int = 25, page_tokens: int = 1024) -> Column:
    """Model tokens that a placeholder stands for: image patches, audio frames, document pages; 1 at least."""
    size = (
        F.when(part["type"] == "image", F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
        .when(part["type"] == "document", part["pages"].cast("bigint") * page_tokens)
    )
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(size.cast("bigint"), F.lit(1).cast("bigint")))


def visit(part: Column) -> Column:
    """The written form of one part: an escaped text or a placeholder; unknown types are written as texts."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted string per conversation, with attachments and loss mask.

    ``turns`` has ``conv_id, turn, role, parts``: an array of structs with ``type`` and any of ``text, ref, width,
    height, seconds, pages``.  Turns go by ``turn`` (nulls first), ties by role and content; repeated rows stay.
    Null roles, parts and texts are empty; a null ``conv_id`` is a conversation of its own; other columns are ignored.

    Returns ``conv_id, formatted, attachments`` (in the order of their placeholders: kind, ref, tokens),
    ``expanded_tokens`` (sum over attachments) and ``loss_spans`` (start and length in code points of the contents of
    ``loss_roles``).  One row holds a whole conversation, as its reader needs it.
    """
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    flat = turns.select("conv_id", "turn", "role", _whole(turns, "parts").alias("parts")).select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            F.concat_ws("", F.transform("parts", visit)).alias("content"),
            F.transform(
                F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)),
                lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
            ).alias("attachments"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    # Where each turn begins, as a running sum in the order of the turns.
    before = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    size = F.lit(len(START) + 1 + len(END)) + F.length(F.col("t.role")) + F.length(F.col("t.content"))
    placed = flat.withColumn("at", F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0)))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t.*", "at"))).alias("ts"))
    spans = F.transform(
        F.filter("ts", lambda t: t["loss"]),
        lambda t: F.struct((t["at"] + len(START) + F.length(t["role"]) + 1).cast("bigint").alias("start"), F.length(t["content"]).cast("bigint").alias("length")),
    )
    written = F.transform("ts", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["content"], F.lit(END)))
    attachments = F.flatten(F.transform("ts", lambda t: t["attachments"]))
    return whole.select(
        "conv_id",
        F.concat_ws("", written).alias("formatted"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text, unescaped; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    bare = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between spans."""
    return F.concat_ws(
        "", F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )
