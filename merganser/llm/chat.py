"""Chat formatting with Spark expressions only: turns become one string with marks, and a loss mask over it.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one message, whose
texts keep a mark between them, so that the turns can be read back. A message is
``<|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n``. Inside a text, a control string gets one backslash after its
first character, and one that has backslashes there already gets one more, so unescaping takes back exactly what escaping
put in and no text can hold a mark. The loss mask is a list of spans of code points, one for each assistant text.

A conversation of very many turns is no single row: turns are cut into sections by their number, each a row of its own
with its own messages. Nearly all conversations have one section, and those are never shuffled again when read back.

Defined results: a null text is empty, a null role is a role of no characters; rows without a conversation id are one
conversation; turns of one number are ordered by role and text, those without a number come first; repeated rows are
repeated turns; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What may follow the first character of a control string: ``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``; ``[INST]``, ``[/INST]``.
AFTER_ANGLE, AFTER_BRACKET = r"\\*(?:\||/?s>|</?SYS>>)", r"\\*/?INST\]"
#: Turns of so many consecutive numbers are one section.
SECTION = 1024
#: At most so many ids of conversations with several sections are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
FOREVER = 2**31 - 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=<)(?={AFTER_ANGLE})|(?<=\[)(?={AFTER_BRACKET})", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=<)\\(?={AFTER_ANGLE})|(?<=\[)\\(?={AFTER_BRACKET})", "")


def _role_out(role: Column) -> Column:
    """A role is one line: backslashes and line ends are written with two characters."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def _with_alone(turns: DataFrame, section: int) -> DataFrame:
    """Adds ``alone``: the conversation has no turn outside the first section, so its only row is all of it."""
    far = turns.filter(F.col("turn").isNull() | (F.col("turn") >= section) | (F.col("turn") <= -section))
    far = far.select(F.col("conv_id").alias("far")).distinct().withColumn("several", F.lit(True))
    n = far.count()  # reads two columns of the row groups that hold such numbers
    if n == 0:
        return turns.withColumn("alone", F.lit(True))
    found = turns.join(F.broadcast(far) if n <= BROADCAST else far, F.col("conv_id").eqNullSafe(F.col("far")), "left")
    return found.select(*turns.columns, F.col("several").isNull().alias("alone"))


def format_chats(df: DataFrame, trained: str = "assistant", section: int = SECTION) -> DataFrame:
    """One row per conversation and section: conv_id, section, alone, formatted, loss (spans: start from 0, length)."""
    turns = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = _with_alone(turns, section).withColumn("section", F.expr(f"turn div {section}"))
    held = turns.groupBy("conv_id", "section", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast(held.schema["turns"].dataType.elementType)), F.slice("turns", 1, F.size("turns") - 1))

    def written(turn: Column, last: Column) -> Column:
        opened = F.concat(F.lit(START), _role_out(turn["role"]), F.lit("\n"))
        mark = F.when(last.isNull(), opened).when(last["role"] != turn["role"], F.concat(F.lit(END), opened)).otherwise(F.lit(SEP))
        return F.struct(mark.alias("mark"), escape(turn["text"]).alias("text"), (turn["role"] == trained).alias("trained"))

    spans = "array<struct<start:bigint,length:bigint>>"

    def masked(so_far: Column, p: Column) -> Column:
        start, size = so_far["at"] + F.length(p["mark"]), F.length(p["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("at"), F.when(p["trained"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    return (
        held.withColumn("pieces", F.zip_with("turns", before, written))
        .withColumn("formatted", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END)))
        .withColumn("loss", F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans")), masked)["spans"])
        .select("conv_id", "section", "alone", "formatted", "loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""

    def texts(message: Column) -> Column:
        rest = F.substring(message, len(START) + 1, FOREVER)
        role = F.substring_index(rest, "\n", 1)
        body = F.substring(rest, F.length(role) + 2, F.lit(FOREVER))
        return F.transform(F.split(body, rf"\Q{SEP}\E"), lambda t: F.struct(_role_in(role).alias("role"), unescape(t).alias("text")))

    messages = F.split(formatted, rf"\Q{END}\E")
    return F.flatten(F.transform(F.slice(messages, 1, F.size(messages) - 1), texts))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped span by span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """One row per conversation of what ``format_chats`` wrote: numbers and digests of the turns and of the masked text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sections = chats.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        "section",
        "alone",
        F.size("turns").cast("long").alias("n_turns"),
        said.alias("said"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learnt"),
        F.length("formatted").cast("long").alias("chars"),
    )
    parts = F.sort_array(F.collect_list(F.struct("section", "said", "learnt")))
    several = (
        sections.filter(~F.col("alone"))
        .groupBy("conv_id")
        .agg(F.sum("n_turns").alias("n_turns"), parts.alias("parts"), F.sum("chars").alias("chars"), F.count("*").alias("n_sections"))
        .select("conv_id", "n_turns", F.array_join("parts.said", "").alias("said"), F.array_join("parts.learnt", "").alias("learnt"), "chars", "n_sections")
    )
    single = sections.filter("alone").select("conv_id", "n_turns", "said", "learnt", "chars", F.lit(1).cast("long").alias("n_sections"))
    return single.unionByName(several).select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        "n_sections",
    )
