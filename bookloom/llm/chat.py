r"""Chat formatting of typed content parts.

A visitor walks the parts of each message in order: texts become escaped text,
adjacent ones as the one text that they are; an image, audio or document part
becomes a placeholder, and its reference, place and expanded token count are
recorded.  Messages are then marked as

    <|turn|>ROLE<|text|>BODY<|end|>\n

Control strings inside texts and roles (``<|``, ``<s>``, ``[INST]`` and their
like) are broken by a backslash after their first character, and backslashes
are doubled; so no text can open or close a turn, and ``unescape`` gives back
each text exactly.  ``parse`` reads messages and the text under the loss mask
back from the formatted string.

Scale: escaping happens before the one shuffle, by conversation; offsets come
from a running sum, so a conversation costs time linear in its turns.  Its
formatted string is the result and so is held whole by one task, no more.
Only DataFrame functions are used.

Defined cases: null text, null role and null parts are empty; a part of null
type is text, one of an unknown type is an attachment of no tokens; turns
order by number, nulls first, then by role and content; equal rows are all
kept; a null conversation id is one conversation; no rows, no conversations.
Placeholders of unknown types begin with ``part_``, so none can be taken for a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that mean something to this or to other common templates.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 768


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_parts(text: Column) -> Column:
    """A text as the only part of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def expanded_tokens(p: Column) -> Column:
    """Tokens that a model puts in the place of an attachment's placeholder."""
    side = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / PATCH)
    return (
        F.when(p["type"] == "image", side("width") * side("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def visit(parts: Column) -> Column:
    """Body of a message: texts escaped, attachments as placeholders, in order.

    A control string may be dealt over adjacent texts, so these are joined
    before they are escaped.
    """
    kind = lambda p: F.when(p["type"].isin(*KINDS), p["type"]).otherwise(F.concat(F.lit("part_"), F.regexp_replace(p["type"], r"[^A-Za-z0-9_]", "_")))
    state = lambda done, text: F.struct(done.alias("done"), text.alias("text"))

    def step(s: Column, p: Column) -> Column:
        placed = F.concat(s["done"], escape(s["text"]), F.lit("<|"), kind(p), F.lit("|>"))
        return F.when(_is_text(p), state(s["done"], F.concat(s["text"], F.coalesce(p["text"], F.lit(""))))).otherwise(state(placed, F.lit("")))

    body = F.aggregate(parts, state(F.lit(""), F.lit("")), step, lambda s: F.concat(s["done"], escape(s["text"])))
    return F.coalesce(body, F.lit(""))


def attachments(parts: Column) -> Column:
    """Array of (part, kind, ref, tokens) of the parts that aren't text."""
    listed = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    kept = F.filter(listed, lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")
    return F.coalesce(kept, F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turns, attachments, expanded_tokens), a row per conversation.

    ``turns`` has, per message, the code point offsets in ``formatted`` of the
    message and of its body, and whether the body is under the loss mask.
    """
    r = escape(F.coalesce(F.col(role), F.lit("")))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        (F.coalesce(F.col(role), F.lit("")) == loss_role).alias("loss"),
        F.concat(F.lit(TURN), r, F.lit(TEXT)).alias("head"),
        visit(F.col(parts)).alias("body"),
        attachments(F.col(parts)).alias("att"),
    ).withColumn("whole", F.length("head") + F.length("body") + len(END))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "head", "body", "att")
    rows = rows.withColumn("nth", F.row_number().over(in_order)).withColumn("at", F.coalesce(F.sum("whole").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "at", "head", "body", "loss", "att"))).alias("m"))
    spans = F.transform("m", lambda m: F.struct(m["at"].alias("at"), (m["at"] + F.length(m["head"])).alias("start"), (m["at"] + F.length(m["head"]) + F.length(m["body"])).alias("end"), m["loss"].alias("loss")))
    att = F.flatten(F.transform("m", lambda m: F.transform(m["att"], lambda a: F.struct((m["nth"] - 1).alias("message"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("turns"),
        att.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parse(chats: DataFrame) -> DataFrame:
    """Adds ``messages`` (role, text) and ``loss_text``, both read back from ``formatted``.

    A message's piece is found by the marks alone, the text under the loss mask
    by the offsets alone (taken within the piece, so a long conversation isn't
    walked from its start for each).
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.size("turns"))
    cut = lambda p: F.substring_index(p, END, 1)
    messages = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substr(cut(p), F.length(F.substring_index(p, TEXT, 1)) + F.lit(len(TEXT) + 1))).alias("text"),
        ),
    )
    loss = F.transform(
        F.filter(F.zip_with("__bl_pieces", "turns", lambda p, t: F.struct(p.alias("p"), t.alias("t"))), lambda x: x["t"]["loss"]),
        lambda x: unescape(F.substr(x["p"], (x["t"]["start"] - x["t"]["at"] - len(TURN) + 1).cast("int"), (x["t"]["end"] - x["t"]["start"]).cast("int"))),
    )
    return chats.withColumn("__bl_pieces", pieces).withColumn("messages", messages).withColumn("loss_text", F.array_join(loss, "")).drop("__bl_pieces")
