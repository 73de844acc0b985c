"""Chat formatting by prefix-target expansion; only DataFrame functions.

A turn is written ``[INST]role[/INST]text</s>``. Inside roles and texts a backslash is doubled and the three
control strings get one after their first character, so that none of them occurs there and reading back is exact.

Every assistant turn becomes an example of its own: its context is the conversation up to the reply, only the
reply is trainable. Contexts of one conversation are prefixes of one another, so the conversation is stored once
and an example refers to its prefix by length; :func:`whole_examples` writes prefixes out where they are wanted.

Defined cases: a null role or text is empty; turns are in order of (turn, role, text), nulls first; a repeated row
is a turn of its own; a conversation without an assistant has no example; a null conv_id is one conversation.
A conversation is one string (its digest needs it whole) and thus below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The control strings and their escaped forms.
CONTROL = {"[INST]": "[\\INST]", "[/INST]": "[\\/INST]", "</s>": "<\\/s>"}
OPEN, SHUT, END = CONTROL


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in CONTROL.items():
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in CONTROL.items():
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = W.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    rows = conversations.select("conv_id", "turn", role.alias("_role"), text.alias("_text"))
    return (
        rows.withColumn("_no", F.row_number().over(line))
        .withColumn("_head", F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(SHUT)))
        .withColumn("_body", escape(F.col("_text")))
        .withColumn("_chars", F.length("_head") + F.length("_body") + len(END))
        .withColumn("_from", F.sum("_chars").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("_chars"))
    )


def format_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The formatted conversations (conv_id, formatted) and the examples.

    An example has conv_id, example (its number), context_chars (the prefix of ``formatted`` that is its context),
    reply_chars and reply (the escaped text under the loss mask, which starts at context_chars).
    """
    turns = _turns(conversations)
    pieces = F.array_sort(F.collect_list(F.struct("_no", F.concat("_head", "_body", F.lit(END)).alias("piece"))))
    formatted = turns.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"))
    examples = turns.filter(F.col("_role") == "assistant").select(
        "conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("_no")).alias("example"),
        (F.col("_from") + F.length("_head")).alias("context_chars"), F.length("_body").cast("long").alias("reply_chars"),
        F.col("_body").alias("reply"))
    return formatted, examples


def whole_examples(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, example, context, reply with the contexts written out (size: square of a conversation's length)."""
    both = examples.join(formatted.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    at = F.col("context_chars").cast("int")
    return both.select("conv_id", "example", F.expr("substring(formatted, 1, int(context_chars))").alias("context"),
                       F.substring("formatted", at + 1, F.col("reply_chars").cast("int")).alias("reply"))


def masked(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, example, context_chars, reply_chars and ``reply``, the text that the mask of each example cuts out of ``formatted``.

    A mask is looked up by the place it starts at, so that a conversation is walked once, not once per example.
    """
    line = W.partitionBy("_conv").orderBy("_no").rowsBetween(W.unboundedPreceding, 0)
    pieces = formatted.select(F.col("conv_id").alias("_conv"), F.posexplode(F.split("formatted", END)).alias("_no", "_piece"))
    pieces = pieces.withColumn("_at", F.sum(F.length("_piece") + len(END)).over(line) - F.length("_piece") - len(END))
    pieces = pieces.withColumn("_body", F.col("_at") + F.locate(SHUT, F.col("_piece")) + len(SHUT) - 1)
    both = examples.drop("reply").join(pieces, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("context_chars") == F.col("_body")))
    reply = F.substring("_piece", (F.col("context_chars") - F.col("_at") + 1).cast("int"), F.col("reply_chars").cast("int"))
    return both.select("conv_id", "example", "context_chars", "reply_chars", reply.alias("reply"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an array of (role, text) parsed from the formatted text alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")

    def parsed(piece):
        halves = F.split(piece, r"\[/INST\]", 2)
        return F.struct(unescape(F.substr(halves[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(halves[1]).alias("text"))

    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(pieces, parsed).alias("turns"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation what the formatted text and the examples hold, read back from them."""
    formatted, examples = format_chats(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), "formatted_chars")
    replies = F.array_sort(F.collect_list(F.struct("example", unescape(F.col("reply")).alias("reply"))))
    loss = masked(formatted, examples).groupBy(F.col("conv_id").alias("_conv")).agg(
        F.array_join(F.transform(replies, lambda r: r["reply"]), "").alias("_loss"),
        F.count(F.lit(1)).alias("n_examples"), F.sum(F.col("context_chars") + F.col("reply_chars")).alias("example_chars"))
    text = F.coalesce("_loss", F.lit(""))
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars", F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("example_chars", F.lit(0)).alias("example_chars"))
