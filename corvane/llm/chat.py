"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is text, or an array of typed parts. Parts are flattened in order: text is escaped, and each image,
audio or document becomes a placeholder, with its reference and the number of tokens that it expands to recorded as an
attachment. A conversation is one string, ``<|turn|>role\\ncontent<|end|>\\n`` for each turn, with the spans of the
assistant's content as loss mask.

Escapes begin with a backslash, so that every backslash of the output is followed by its code: ``\\0`` a backslash,
``\\1`` a line end within a role, ``\\2`` nothing (it stands after the first character of what would else read as a control string).
Control strings are looked for in the joined content, so none can be put together from neighbouring parts either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>\n"
#: What templates of common chat models read as control strings; every ``<|name|>`` begins with the first.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0"))


def _broken(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\2{c[1:]}")), CONTROL, text)


def escaped(text: Column) -> Column:
    return _broken(_plain(text))


def unescaped(text: Column) -> Column:
    for code, plain in (("\\2", ""), ("\\1", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens_of(part: Column, patch: int = 28, per_second: float = 25.0, per_page: int = 256) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text and unknown types, and where a measure is missing."""
    count = F.when(part["type"] == "image", F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch))
    count = count.when(part["type"] == "audio", F.ceil(part["seconds"] * per_second)).when(part["type"] == "document", part["pages"].cast("long") * per_page)
    return F.coalesce(count, F.lit(0)).cast("long")


def flattened(parts: Column) -> Column:
    """The content of an array of PART: escaped texts and placeholders in order; null parts are skipped.

    While the parts are joined and control strings broken, a placeholder stands between two codes that no text has.
    """
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("unknown")
    visit = lambda p: F.when(F.coalesce(p["type"], F.lit("text")) == "text", _plain(p["text"])).otherwise(F.concat(F.lit("\\3"), kind(p), F.lit("\\4")))
    joined = F.array_join(F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), visit), "")
    return F.replace(F.replace(_broken(joined), F.lit("\\3"), F.lit("<|")), F.lit("\\4"), F.lit("|>"))


def attachments(parts: Column, **expansion) -> Column:
    media = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    return F.transform(media, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p, **expansion).alias("n_tokens")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant", **expansion) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start from 1, length, in code points) and attachments per conversation.

    Turns are ordered by number (null last); equal numbers by role, then text or parts, all as they came. ``parts_col`` names an array of PART; without
    it the text is the only part. Null texts, roles and parts count as empty, a null conversation id is one
    conversation, repeated rows are repeated turns, and no rows give no rows. Other columns are not read. A conversation becomes
    one string, so it must fit one task, like any row.
    """
    parts = F.col(parts_col) if parts_col else F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col(text_col), F.lit("ref"), F.lit(None).cast("string"), F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"), F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int")))
    role = F.replace(escaped(F.col(role_col)), F.lit("\n"), F.lit("\\1"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), (F.coalesce(F.col(role_col), F.lit("")) == loss_role).alias("learned"), F.coalesce(F.col(role_col), F.lit("")).alias("own_role"), (F.col(parts_col) if parts_col else F.coalesce(F.col(text_col), F.lit(""))).alias("own"), role.alias("role"), flattened(parts).alias("content"), attachments(parts, **expansion).alias("media"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), "role", F.lit("\n"))).withColumn("width", F.length("head") + F.length("content") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "own_role", "own")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("width").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("upto") - F.col("width") + F.length("head") + 1).cast("int").alias("start"), F.length("content").alias("length"))
    item = F.struct("place", F.concat("head", "content", F.lit(END)).alias("piece"), F.when(F.col("learned"), span).alias("span"), "media")
    grouped = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("items.piece"), "").alias("formatted"),
        F.filter(F.col("items.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("items.media")).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds; placeholders of other parts stay in the text."""
    pieces = F.split(formatted, "<\\|turn\\|>")
    cut = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("piece")))
    return F.transform(cut, lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["piece"].substr(F.length(t["role"]) + 2, F.length(t["piece"]) - F.length(t["role"]) - 1 - len(END))).alias("text")))


def read_learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"], s["length"]))), "")
