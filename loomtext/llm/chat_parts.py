"""Chat formatting with typed content parts, natively.

A message is a list of parts: text, image, audio or document. A visitor turns each part into text of the
template: texts are escaped so that no control string of the template can come from them, attachments become
placeholders in their order. What the placeholders stand for is kept beside the text: kind, reference, turn and
the number of tokens it expands to. The loss mask covers the text parts of the trained roles, and nothing between.

A conversation is one row of the result, whatever its length; its turns meet in one task, as the row itself has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the control strings of the template
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: tokens an attachment expands to when it does not say so itself
TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|`` wherever only backslashes stand between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As a text, and on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\u0000"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\u0000"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    ).cast(f"array<{PART}>")


def _pick(kind: Column, values: dict, other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def visit(part: Column) -> Column:
    """The template's text for a part. Kinds other than the attachments' are texts; a null text is empty."""
    return _pick(part["type"], PLACEHOLDER, escape(F.coalesce(part["text"], F.lit(""))))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDER), F.lit(False))


def format_conversations(messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per conversation from messages (conv_id, turn, role, parts).

    ``formatted``: the text; ``loss``: spans (turn from 1, at: offset in the turn's block, start: offset in the text,
    length) in characters; ``attachments``: kind, ref, turn, tokens in order; ``expanded_tokens``: their sum.

    Fixed results: null roles and null parts are empty, null turns come first, messages with the same turn go by role
    and content, repeated rows stay, null ids are one conversation, an empty table gives no rows; other columns
    are not read.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    seen = F.transform(parts, visit)
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = messages.select("conv_id", "turn", role.alias("role"), parts.alias("parts"), seen.alias("seen"), head.alias("head"))
    turns = turns.withColumn("block", F.concat("head", F.concat_ws("", "seen"), F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "block")
    turns = turns.withColumn("no", F.row_number().over(order))
    before = F.sum(F.length("block").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)))
    lengths = F.transform("seen", F.length)
    spans = F.transform(
        "seen",
        lambda x, i: F.struct(
            F.col("no").alias("turn"),
            (F.length("head") + F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)).alias("at"),
            F.length(x).alias("length"),
            F.element_at("parts", i + 1).alias("part"),
        ),
    )
    kept = F.filter(spans, lambda s: ~_is_attachment(s["part"]) & (s["length"] > 0))
    placed = F.transform(
        kept, lambda s: F.struct(s["turn"].alias("turn"), s["at"].alias("at"), (F.col("start") + s["at"]).alias("start"), s["length"].alias("length"))
    )
    none = F.array().cast("array<struct<turn:int,at:int,start:bigint,length:int>>")
    turns = turns.withColumn("loss", F.when(F.col("role").isin(*trained), placed).otherwise(none))
    attached = F.transform(
        F.filter("parts", _is_attachment),
        lambda p: F.struct(
            p["type"].alias("kind"), p["ref"].alias("ref"), F.col("no").alias("turn"),
            F.coalesce(p["tokens"], _pick(p["type"], TOKENS, F.lit(0)).cast("bigint")).alias("tokens"),
        ),
    )
    rows = turns.select("conv_id", F.struct("no", "block", "loss", attached.alias("attached")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    attachments = F.flatten(F.transform("ts", lambda t: t["attached"]))
    return whole.select(
        "conv_id",
        F.concat_ws("", F.transform("ts", lambda t: t["block"])).alias("formatted"),
        F.flatten(F.transform("ts", lambda t: t["loss"])).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role and text, without attachments) and ``loss_text``, both from the text alone
    and the spans of the mask."""
    marks = "|".join(p.replace("|", r"\|") for p in PLACEHOLDER.values())
    blocks = F.slice(F.split("formatted", START.replace("|", r"\|")), 2, F.size(F.split("formatted", START.replace("|", r"\|"))))
    cut = formatted.withColumn("blocks", F.when(F.length("formatted") > 0, blocks).otherwise(F.array().cast("array<string>")))

    def turn(block: Column) -> Column:
        at = F.instr(block, "\n")
        body = block.substr(at + 1, F.length(block) - at - len(END) - 1)
        return F.struct(
            unescape_role(block.substr(F.lit(1), at - 1)).alias("role"), unescape(F.regexp_replace(body, marks, "")).alias("text")
        )

    # spans count from the start of a block, of which the split has taken the first control string
    masked = F.transform(
        "loss", lambda s: unescape(F.element_at("blocks", s["turn"]).substr(s["at"] - len(START) + 1, s["length"]))
    )
    out = cut.withColumn("turns", F.transform("blocks", turn)).withColumn("loss_text", F.concat_ws("", masked))
    return out.drop("blocks")
