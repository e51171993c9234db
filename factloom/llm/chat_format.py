"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn is ``<s>role\\ntext</s>``. A turn's content is a list of typed parts (text, image, audio, document); a visitor
flattens them in order: a text part gives its escaped text, any other a placeholder ``[kind:number]``, where the number
counts the turn's attachments, and an attachment record with the part's reference, its place and the tokens that it is
expanded to. Control strings all begin with ``<`` or ``[``, and neither occurs in an escaped text: the escape character
``\\`` becomes ``\\0``, ``<`` becomes ``\\1`` and ``[`` becomes ``\\2`` (in a role, a line feed ``\\3`` too), undone in the
opposite order.

The loss mask is the list of the assistant's texts as spans of code points, the control strings excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Tokens that an attachment is expanded to where its part doesn't say.
TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"
_CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(text: Column, extra: tuple = ()) -> Column:
    for plain, code in (*_CODES, *extra):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, extra: tuple = ()) -> Column:
    for plain, code in reversed((*_CODES, *extra)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


_ROLE = (("\n", "\\3"),)


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(parts: Column) -> tuple[Column, Column]:
    """(flattened text, attachments) of a turn's parts; null parts are none, a null text is empty, a null type is text.

    attachments: array of struct(number, kind, ref, part, tokens), in order."""
    typed = F.filter(F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p, i: F.struct(i.alias("part"), F.coalesce(p["type"], F.lit("text")).alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda p: p["kind"].isNotNull())
    others = F.filter(typed, lambda p: p["kind"] != "text")
    fallback = F.create_map(*[x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v))])
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["part"].alias("part"), F.coalesce(p["tokens"], F.try_element_at(fallback, p["kind"]), F.lit(0)).alias("tokens")))
    number = F.transform(others, lambda p: p["part"])
    flat = F.transform(typed, lambda p: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("["), escape(p["kind"]), F.lit(":"), (F.array_position(number, p["part"]) - 1).cast("string"), F.lit("]"))))
    return F.array_join(flat, ""), attachments


def format_conversations(turns: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", speaker: str = "assistant") -> DataFrame:
    """(conv, formatted string, loss, attachments, n_tokens_attached) for each conversation.

    ``parts`` is the column of typed parts, of type ``PARTS``. Turns are ordered by ``turn`` (null first), then role and
    text; equal rows are turns each. A null role is empty; null parts are an empty text; rows of a null conversation id
    are one conversation. loss: array of struct(turn, start, chars) of the speaker's texts: the turn's number, and code
    points of ``formatted``. attachments: of all turns, with the turn's number. A conversation is one value of one row,
    so its size is bounded by that of a value (2 GB).
    """
    flat, attached = visit(parts)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flat.alias("text"), attached.alias("attached"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), _ROLE), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "text", "attached", head.alias("head")).withColumn("chars", F.length("head") + F.length("text") + len(CLOSE))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("number", F.row_number().over(before) - 1)
    rows = rows.withColumn("start", F.sum("chars").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"))
    row = F.struct("number", "start", "role", "head", "text", "attached")
    got = rows.groupBy("conv").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    whole = F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["text"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter("rows", lambda r: r["role"] == speaker), lambda r: F.struct(r["number"].alias("turn"), (r["start"] + F.length(r["head"])).alias("start"), F.length(r["text"]).alias("chars")))
    every = F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["number"].alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["part"].alias("part"), a["tokens"].alias("tokens")))))
    out = got.select(F.col("conv").alias(conv), whole.alias("formatted"), loss.alias("loss"), every.alias("attachments"))
    return out.withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns, struct(role, text), of a formatted conversation whose parts are texts."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    bodies = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 2147483647))
    return F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1), _ROLE).alias("role"), unescape(b.substr(F.instr(b, "\n") + 1, F.length(b))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped: read from each masked turn's piece, so that no text is scanned twice."""
    pieces = F.split(formatted, CLOSE)
    return F.array_join(F.transform(loss, lambda s: unescape(F.right(F.element_at(pieces, s["turn"] + 1), s["chars"]))), "")
