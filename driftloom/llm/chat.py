"""Chat formatting with typed content parts, in DataFrame functions only.

Turns carry ordered parts of the types text, image, audio and document.  Visiting a part gives its placeholder or
its escaped text, an attachment reference with its place, and the number of tokens that the placeholder expands to.

Template: each turn is ``<s>[INST:role] content [/INST]</s>`` without the blanks.  Control strings begin with ``<`` or
``[``; in roles and texts these and ``&`` are written as ``&lt;``, ``&#91;`` and ``&amp;`` (a role's ``]`` as ``&#93;``), so
no text can imitate the template and unescaping gives it back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
OPEN, ROLE_END, CLOSE = "<s>[INST:", "]", "[/INST]</s>"
#: Tokens: an image has one per patch of PATCH x PATCH pixels, audio so many a second, a document so many a page.
PATCH, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 500


def escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in (("&#93;", "]"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def text_part(text: Column) -> Column:
    """One part of type text."""
    null = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))


def expanded_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to: 0 for text, 1 at least for an attachment."""
    n = F.when(p["type"] == "image", F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH))
    n = n.when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_PER_SECOND)).when(p["type"] == "document", p["pages"].cast("long") * DOCUMENT_PER_PAGE)
    return F.when(F.coalesce(p["type"], F.lit("text")) == "text", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("long"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_expanded_tokens.

    ``loss_spans``: (start, length) in code points of ``formatted`` of each ``loss_role`` turn's content, in order.
    ``attachments``: (index, turn, type, uri, start, n_tokens) in order; placeholders are ``<|type:index|>``.
    Null roles, parts and texts are empty; unknown part types are attachments of one token; turns are in order of
    (turn, role, parts), nulls first, also where turns repeat; null conversation ids are one conversation.
    A conversation is one row, as its text is one string.
    """
    text = F.coalesce(F.lit(None).cast("string"), F.lit(""))
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # number the attachments: those of each turn follow the ones before
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    counts = F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: ~is_text(p))))
    conv = conv.withColumn("none", F.aggregate(counts, F.lit(0), lambda a, c: a + c) == 0)
    empty = F.array().cast("array<struct<s:string,index:int,type:string,uri:string,n:bigint>>")

    def visit(state: Column, p: Column) -> Column:
        index = F.size(F.filter(state, lambda v: v["index"].isNotNull()))
        name = F.when(is_text(p), escape(F.coalesce(p["text"], text))).otherwise(F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), index.cast("string"), F.lit("|>")))
        item = F.struct(name.alias("s"), F.when(~is_text(p), index).alias("index"), F.when(~is_text(p), p["type"]).alias("type"), F.when(~is_text(p), p["uri"]).alias("uri"), expanded_tokens(p).alias("n"))
        return F.concat(state, F.array(item))

    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))
    # visited parts, turn by turn; without attachments each turn stands alone and nothing has to be carried along
    alone = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), head(t).alias("head"), F.transform(t["parts"], lambda p: F.struct(escape(F.coalesce(p["text"], text)).alias("s"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("long").alias("n"))).alias("v")))
    flat = F.aggregate(F.flatten(F.transform("turns", lambda t: t["parts"])), empty, visit)
    before = F.transform("turns", lambda t, i: F.aggregate(F.slice(F.col("turns"), F.lit(1), i), F.lit(0), lambda a, u: a + F.size(u["parts"])))
    conv = conv.withColumn("flat", F.when(~F.col("none"), flat)).withColumn("before", F.when(~F.col("none"), before))
    carried = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), head(t).alias("head"), F.slice(F.col("flat"), F.col("before")[i] + 1, F.size(t["parts"])).alias("v")))
    conv = conv.select("conv", F.size("turns").cast("long").alias("n_turns"), F.when(F.col("none"), alone).otherwise(carried).alias("turns"))
    body = lambda t: F.array_join(F.transform(t["v"], lambda v: v["s"]), "")
    conv = conv.withColumn("turns", F.transform("turns", lambda t: t.withField("body", body(t))))
    conv = conv.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""))
    place = "array<struct<head:bigint,body:bigint>>"
    sizes = F.transform("turns", lambda t: F.struct(F.length(t["head"]).cast("long").alias("head"), F.length(t["body"]).cast("long").alias("body")))
    first = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(place).alias("at"))

    def put(state: Column, x: Column) -> Column:
        start = state["end"] + x["head"]
        return F.struct((start + x["body"] + len(CLOSE)).alias("end"), F.concat(state["at"], F.array(F.struct(start.alias("head"), x["body"].alias("body")))).alias("at"))

    conv = conv.withColumn("at", F.aggregate(sizes, first, put)["at"])
    spans = F.filter(F.zip_with("turns", "at", lambda t, a: F.struct((t["role"] == loss_role).alias("on"), a["head"].alias("start"), a["body"].alias("length"))), lambda x: x["on"])
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    def placed(t: Column, a: Column) -> Column:
        every = F.transform(t["v"], lambda v, i: F.struct(v["index"].alias("index"), t["turn"].alias("turn"), v["type"].alias("type"), v["uri"].alias("uri"), (a["head"] + F.aggregate(F.slice(t["v"], F.lit(1), i), F.lit(0).cast("long"), lambda s, u: s + F.length(u["s"]))).alias("start"), v["n"].alias("n_tokens")))
        return F.filter(every, lambda x: x["index"].isNotNull())

    attachments = F.flatten(F.zip_with("turns", "at", placed))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"])
    out = conv.select(F.col("conv").alias(conv_col), "n_turns", "formatted", spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("n_expanded_tokens", tokens)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation without attachments."""
    turns = F.filter(F.split(formatted, r"\[/INST\]</s>", -1), lambda s: s != "")
    role = lambda s: F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), ROLE_END, 1)
    return F.transform(turns, lambda s: F.struct(unescape(role(s)).alias("role"), unescape(F.substr(s, F.lit(len(OPEN) + 2) + F.length(role(s)))).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: each span once, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
