"""Conversations of typed content parts as one formatted text with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import col

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER_PLACEHOLDER = "<|attachment|>"
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    r"""Backslashes and bars get a backslash before them, so no text can hold a ``<|...|>``."""
    return F.regexp_replace(text, r"([\\|])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(part: Column) -> Column:
    """What a part becomes: escaped text, or the placeholder of its type once for each token
    that the attachment takes (at least once)."""
    holder = F.lit(OTHER_PLACEHOLDER)
    for kind, mark in PLACEHOLDERS.items():
        holder = F.when(part["type"] == kind, F.lit(mark)).otherwise(holder)
    expanded = F.call_function("repeat", holder, tokens_of(part))
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(expanded)


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def tokens_of(part: Column) -> Column:
    return F.greatest(F.coalesce(part["tokens"], F.lit(1)), F.lit(1))


def format_chats(
    messages: DataFrame,
    parts: Column,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns, loss_spans, attachments``.

    ``parts`` gives the typed parts of a message (``PARTS``). A visitor turns each part into its
    piece of the text in order: text is escaped, an image, audio or document part becomes its
    placeholder repeated to its token count, and its reference is kept in ``attachments``
    (position, turn, type, ref, tokens). ``loss_spans`` (start, length in code points) covers
    the text parts of ``loss_role`` and nothing else.

    Messages go by turn, then role, then parts, nulls first; repeated rows stay as repeated
    messages. A null role or text is the empty one; a message without parts keeps its marks; a
    part without a type is text, an unknown type takes a general placeholder. Rows without a
    conversation id form one conversation. Other columns are ignored.

    The place of a piece is a running sum over the conversation, so a long conversation is
    sorted on disk and only its one resulting text is held whole.
    """
    rows = messages.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.coalesce(parts, F.expr(f"CAST(array() AS {PARTS})")).alias("parts"),
        F.monotonically_increasing_id().alias("row"),
    )
    pieces = rows.select("conv_id", "turn", "role", "parts", "row", F.posexplode_outer("parts").alias("no", "part"))
    no, part = F.coalesce("no", F.lit(0)), F.col("part")
    head = F.when(no == 0, F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).otherwise("")
    tail = F.when(no >= F.size("parts") - 1, F.lit(END)).otherwise("")
    body = F.when(part.isNull(), F.lit("")).otherwise(visit(part))
    pieces = pieces.select("*", no.alias("at"), head.alias("head"), body.alias("body"), tail.alias("tail"))
    order = ["turn", "role", "parts", "row", "at"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.select(
        "conv_id",
        (F.sum(F.length("head") + F.length("body") + F.length("tail")).over(before) - F.length("body") - F.length("tail")).alias("start"),
        F.count(F.lit(1)).over(before).alias("rank"),
        F.concat("head", "body", "tail").alias("piece"),
        F.length("body").cast("long").alias("length"),
        (no == 0).cast("long").alias("opens"),
        (part.isNotNull() & is_text(part) & (F.col("role") == loss_role)).alias("loss"),
        F.when(part.isNotNull() & ~is_text(part), F.struct(F.col("turn"), part["type"].alias("type"), part["ref"].alias("ref"), tokens_of(part).alias("tokens"))).alias("attachment"),
    )
    item = F.struct("rank", "piece", "start", "length", "loss", "attachment")
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("opens").alias("n_turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        "n_turns",
        F.transform(F.filter("items", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.transform(
            F.filter("items", lambda x: x["attachment"].isNotNull()),
            lambda x: F.struct(x["start"].alias("start"), x["attachment"]["turn"].alias("turn"), x["attachment"]["type"].alias("type"), x["attachment"]["ref"].alias("ref"), x["attachment"]["tokens"].alias("tokens")),
        ).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text); the inverse of the template
    for text parts. Placeholders of attachments stay in the text as they are."""
    bodies = F.filter(F.split(formatted, START.replace("|", r"\|")), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, SEP, 1)
        text = F.substr(x, F.length(role) + len(SEP) + 1, F.length(x) - F.length(role) - len(SEP) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(chats: DataFrame) -> DataFrame:
    """Formatted conversations read back: counts and hashes of turns and loss-bearing text."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
