"""Operator 7, chat formatting with typed content parts.

A message's content is an array of parts (text, image, audio, document). The visitor turns it into
one string, in which a text is escaped and any other part becomes a placeholder; the k-th placeholder
of a conversation stands for the k-th entry of its attachments, which carry the reference and the
number of tokens that the placeholder expands to. DataFrame functions only.

Template: ``<|im_start|>role\\nbody<|im_end|>\\n`` per turn. In a body every ``<`` of a text is
followed by a backslash, so that control strings, which start with ``<|``, cannot come from texts,
even where two parts meet. In a role ``%``, line feed and ``<`` are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that a placeholder expands to: image patches of 28 x 28 pixels, audio frames a second,
#: tokens a document page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 256


def text_part(text: Column) -> Column:
    """A content array of one text part; a null text is empty."""
    kind = F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(kind)


def escape_text(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape_text(body: Column) -> Column:
    return F.replace(body, F.lit("<\\"), F.lit("<"))


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*KINDS), F.lit(False))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; sizes that are not given count as 0."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .cast("long")
    )


def visit(content: Column) -> Column:
    """The body of a message. Parts of another kind count as their text."""
    return F.array_join(F.transform(content, lambda p: F.when(_is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape_text(F.coalesce(p["text"], F.lit(""))))), "")


def attachments(content: Column) -> Column:
    """(kind, ref, tokens) of the parts that are placeholders, in order."""
    return F.transform(F.filter(content, _is_attachment), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, n_turns, formatted, loss_spans (start, end in code
    points of ``formatted``: the bodies of ``learn`` turns), attachments (turn, kind, ref, tokens) and
    n_attachment_tokens.

    Turns are ordered by ``turn_col`` (nulls first), then by role and body; repeated rows are turns of
    their own. A null role is empty, a null or empty content an empty body, a null conversation id a
    conversation like any other. Other columns are ignored; an empty table gives no rows. A
    conversation is one output value, so its rows meet in one task.
    """
    role = escape_role(F.coalesce(F.col(role_col).cast("string"), F.lit("")))
    content = F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>"))
    turns = messages.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), visit(content).alias("body"), attachments(content).alias("attachments")).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = F.transform("t", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n")))
    whole = whole.withColumn("head", heads).withColumn("text", F.transform("t", lambda t, i: F.concat(F.col("head")[i], t["body"], F.lit(END + "\n"))))
    # start of each turn in the output: running sum of the lengths before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("text", zero, lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    whole = whole.withColumn("starts", starts)
    spans = F.transform("t", lambda t, i: F.struct((F.col("starts")[i] + F.length(F.col("head")[i])).alias("start"), (F.col("starts")[i] + F.length(F.col("head")[i]) + F.length(t["body"])).alias("end"), (t["role"] == learn).alias("on")))
    files = F.flatten(F.transform("t", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    whole = whole.withColumn("attachments", files)
    return whole.select(
        F.col("conv").alias(conv_col),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join("text", "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay as they are."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    bare = F.transform(parts, lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(bare, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape_text(F.substr(x, F.locate("\n", x) + 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(messages: DataFrame) -> DataFrame:
    """What the contract asks of formatted conversations, read back from the output."""
    out = format_conversations(messages)
    return out.select(
        "conv_id",
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(read_loss(F.col("formatted"), F.col("loss_spans"))).cast("long").alias("loss_chars"),
        F.sha2(read_loss(F.col("formatted"), F.col("loss_spans")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
