"""Chat formatting (1): turns of typed content parts as one text, with loss spans and attachments.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: an image by patches of 14 pixels (one at least), audio by 25 a second, a document by 256 a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 256


def escape(c: Column) -> Column:
    """No '<' or '[' is left, so no control string can arise inside a text; unescape() is the inverse."""
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")))).cast(f"array<{PART}>")


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _tokens(p: Column) -> Column:
    side = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / PATCH))
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND)))
        .when(p["type"] == "document", F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(0))) * PER_PAGE)
        .otherwise(F.lit(1))
        .cast("long")
    )


def _placeholder(p: Column) -> Column:
    return F.when(p["type"].isin("image", "audio", "document"), F.concat(F.lit("<"), p["type"], F.lit(">"))).otherwise("<file>")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, parts): conv_id, n_turns, formatted,
    loss_spans (start, end) in code points, attachments (turn_no, part_no, type, ref, n_tokens)
    and expanded_tokens, the sum of the last.

    Each part is visited in order: a text is escaped, an attachment becomes a placeholder; the
    i-th placeholder of the text belongs to the i-th attachment. A turn is
    <turn>role<text>content</turn>; an assistant's content is under the loss mask.

    Turns are ordered by turn (null first), then role, then text (placeholders in it), so ties and repeated rows have
    one order and all stay. Null role and text are empty; a part without a type is a text; an
    unknown type is a <file> of one token; null or empty parts give an empty content. Null conv_ids are
    one conversation. What meets in one task is one conversation, which is one row of the result.
    """
    content = F.array_join(F.transform("parts", lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p))), "")
    files = F.filter(F.transform("parts", lambda p, i: F.when(~_is_text(p), F.struct((i + 1).alias("part_no"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("n_tokens")))), lambda x: x.isNotNull())
    role = F.coalesce("role", F.lit(""))
    said = F.array_join(F.transform("parts", lambda p: F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(_placeholder(p))), "")
    one = turns.select("conv_id", F.struct("turn", role.alias("role"), said.alias("said"), F.coalesce(content, F.lit("")).alias("content"), F.coalesce(files, F.array().cast("array<struct<part_no:int,type:string,ref:string,n_tokens:bigint>>")).alias("files")).alias("t"))
    convs = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY))
    span = "struct<start:bigint,end:bigint>"

    def step(at, t):
        begin = at + F.char_length(head(t))
        end = begin + F.char_length(t["content"])
        new = F.when(t["role"] == "assistant", F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))).otherwise(F.array().cast(f"array<{span}>"))
        return (end + len(CLOSE)).cast("long"), new

    attached = F.flatten(F.transform("ts", lambda t, i: F.transform(t["files"], lambda f: F.struct((i + 1).alias("turn_no"), f["part_no"].alias("part_no"), f["type"].alias("type"), f["ref"].alias("ref"), f["n_tokens"].alias("n_tokens")))))
    return convs.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["content"], F.lit(CLOSE))), "").alias("formatted"),
        scan(F.col("ts"), F.lit(0).cast("long"), span, step).alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation of texts, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    at = lambda t: F.char_length(F.substring_index(t, BODY, 1))
    return F.transform(turns, lambda t: F.struct(unescape(F.substr(t, F.lit(len(OPEN) + 1), at(t) - len(OPEN))).alias("role"), unescape(F.substr(t, at(t) + len(BODY) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
