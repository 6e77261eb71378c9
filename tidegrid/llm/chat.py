"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn is ``<s>`` role ``[TEXT]`` content ``</s>``; a conversation is its turns in
order of (turn, role, content). Content is a text or an array of typed parts
(type, text, ref, amount): a visitor writes texts as they are and each image, audio
or document part as the placeholder ``[IMAGE n]``, ``[AUDIO n]`` or ``[DOCUMENT n]``,
n counting the conversation's attachments. Each attachment keeps its reference
and how many tokens its placeholder expands to (``TOKENS`` for each unit of
``amount``: image tiles, audio seconds, document pages; at least one unit).

Control strings all begin with ``<`` or ``[``. In roles and texts these two and
``&`` are escaped as ``&lt;``, ``&lsqb;`` and ``&amp;``, so no text can hold a control
string and reading back is exact. The loss mask is a list of code-point spans of
the formatted text: the contents of assistant turns.

Cases: a null text, role, part or array is empty; a part of any other type is
written as its text; ties in ``turn`` go by role and content, repeated rows
stay; a null conversation id is a conversation; an empty table gives no rows;
other columns are not read. A conversation is one string, so it must fit in one
task, as it must in a training example; no other rows meet in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Escapes, in the order in which they are applied; reading back takes the reverse one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: Tokens for each unit of a part's amount.
TOKENS = {"image": 85, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


#: What the visitor reads.
_PARTS = "array<struct<type:string,text:string,ref:string,amount:double>>"


def _parts(content: Column) -> Column:
    """Visits typed parts: an array of (kind, text, ref, tokens); kind is null for text."""

    def visit(p: Column) -> Column:
        kind = F.when(p["type"].isin(*TOKENS), p["type"])
        each = reduce(lambda c, k: c.when(kind == k, F.lit(TOKENS[k])), TOKENS, F.when(F.lit(False), 0)).otherwise(0)
        units = F.greatest(F.ceil(F.coalesce(p["amount"].cast("double"), F.lit(1.0))), F.lit(1))
        return F.struct(kind.alias("kind"), escape(F.coalesce(p["text"], F.lit(""))).alias("text"), p["ref"].cast("string").alias("ref"), (each * units).cast("long").alias("tokens"))

    return F.transform(F.filter(F.coalesce(content, F.array().cast(_PARTS)), lambda p: p.isNotNull()), visit)


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, loss_spans, attachments (index, kind, ref, tokens)."""
    body = F.col(content)
    if not isinstance(turns.schema[content].dataType, ArrayType):  # a text is its only part
        body = F.array(F.struct(F.lit("text").alias("type"), body.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))
    body = body.cast(_PARTS)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), _parts(body).alias("parts")).alias("row"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # Number the attachments: each turn's parts start after those of the turns before.
    counted = whole.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["parts"].alias("parts"), F.size(F.filter(r["parts"], lambda p: p["kind"].isNotNull())).alias("n"))).alias("rows"))
    flat = F.filter(F.flatten(F.transform("rows", lambda r: r["parts"])), lambda p: p["kind"].isNotNull())
    first = F.aggregate("rows", F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["n"])))
    counted = counted.select("conv_id", "rows", F.transform(flat, lambda p, i: F.struct(i.alias("index"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"), first.alias("first"))

    def written(r: Column, i: Column) -> Column:
        """The content of a turn, placeholders in."""
        start = F.aggregate(  # (text so far, attachments so far)
            r["parts"],
            F.struct(F.lit("").alias("text"), F.get(F.col("first"), i).alias("n")),
            lambda acc, p: F.struct(
                F.concat(acc["text"], F.when(p["kind"].isNull(), p["text"]).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit(" "), acc["n"].cast("string"), F.lit("]")))).alias("text"),
                (acc["n"] + p["kind"].isNotNull().cast("int")).alias("n"),
            ),
        )
        return start["text"]

    told = counted.select("conv_id", "attachments", F.transform("rows", lambda r, i: F.struct((r["role"] == "assistant").alias("loss"), F.concat(F.lit("<s>"), escape(r["role"]), F.lit("[TEXT]")).alias("head"), written(r, i).alias("body"))).alias("turns"))
    sized = told.select("*", F.transform("turns", lambda t: F.struct(t["loss"].alias("loss"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"))).alias("sizes"))
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + 4).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    return sized.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), spans.alias("loss_spans"), "attachments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped; placeholders stay."""
    inside = F.slice(F.split(formatted, "</s>"), F.lit(1), F.size(F.split(formatted, "</s>")) - 1)
    return F.transform(
        inside,
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, "[TEXT]", 1), F.lit(4))).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, "[TEXT]", 1)) + F.lit(7))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(loss_spans, lambda s: F.substr(formatted, s["start"] + F.lit(1), s["end"] - s["start"])), ""))
