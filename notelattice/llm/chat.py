"""Chat formatting of messages with typed content parts. DataFrame functions alone.

A message is a row: conversation, turn, role and ``content``, an array of parts of the type ``PART``. A visitor turns each
part into a piece: text is escaped; images, audio and documents become placeholders, numbered through the
conversation in the order in which they stand, with their reference and the tokens that they expand to recorded among the
attachments. Parts are rows while this happens, and numbers and offsets are running sums along a conversation, so no
part is looked at twice however long a conversation is. The template:

    <|im_start|>ROLE
    PIECES<|im_end|>

``<|`` opens every control string. Where a text has ``<``, any number of backslashes and ``|``, escaping puts one
backslash more between them, and reading takes one away, so no text holds a control string and every text comes back. A
line end in a role becomes ``<|nl|>``.

The loss mask lists, turn by turn, where the turn begins and the spans of the assistant's text parts in the formatted
string (code points, from 0); marks and placeholders are outside.

Defined cases: a null text is empty. Content that is null or has no parts is one empty text. A null role is empty. A part
of kind null is text; one of an unknown kind gets a placeholder ``attachment`` that expands to no tokens. Rows go by turn,
null turns first; ties by role and content, so equal rows stand side by side and each is a turn. Null ids are one
conversation. No rows give no conversations. Other columns of the input are not used, whatever they are called. A
conversation is one row, so it must fit in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns

PART = (
    "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
)
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
MEDIA = ("image", "audio", "document")


def escaped(text: Column) -> Column:
    """``text`` without ``<|``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_messages(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with plain texts as messages of one text part."""
    values = [F.lit("text"), F.col(text_col), *[F.lit(None)] * 5]
    return rows.withColumn("content", F.array(F.struct(*values).cast(PART)))


def media_tokens(
    part: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256
) -> Column:
    """Tokens that an attachment expands to: image patches, audio frames, document pages. Unknown sizes give 0."""

    def up(value: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))).cast("long")

    patches = up(part["width"] / F.lit(patch)) * up(part["height"] / F.lit(patch))
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", up(part["seconds"] * F.lit(audio_rate)))
        .when(part["kind"] == "document", up(part["pages"]) * F.lit(page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chats(
    messages: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content_col: str = "content",
    loss_role: str = "assistant",
    patch: int = 28,
    audio_rate: float = 25.0,
    page_tokens: int = 256,
) -> DataFrame:
    """``(id_col, formatted, loss, attachments, media_tokens)``, one row per conversation.

    ``loss``: ``(begin, spans)`` of every turn, spans being an array of ``(begin, length)``. ``attachments``: ``(number, kind, uri, turn, part, at,
    tokens)`` with the turn and part counted from 0 and ``at`` the offset of the placeholder.
    """
    check_columns(messages, [id_col, turn_col, role_col, content_col], [])
    rows = messages.select(
        F.col(id_col).alias("_id"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(role_col, F.lit("")).alias("_role"),
        F.col(content_col).cast(f"array<{PART}>").alias("_content"),
    )
    # Both windows, the explode between them and the group keep one partitioning: a single shuffle.
    each = Window.partitionBy("_id")
    rows = rows.withColumn("_no", F.row_number().over(each.orderBy("_turn", "_role", "_content")) - 1)
    size = F.greatest(F.coalesce(F.size("_content"), F.lit(0)), F.lit(1))
    parts = rows.select(
        "_id", "_role", "_no", size.alias("_size"), F.posexplode_outer("_content").alias("_part", "_p")
    ).withColumn("_part", F.coalesce("_part", F.lit(0)))

    kind = F.col("_p.kind")
    is_text = kind.isNull() | (kind == "text")
    name = reduce(lambda c, m: c.when(kind == m, F.lit(m)), MEDIA, F.when(F.lit(False), "")).otherwise("attachment")
    so_far = each.orderBy("_no", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.when(~is_text, F.sum(F.when(is_text, 0).otherwise(1)).over(so_far))
    numbered = parts.withColumns({"_is_text": is_text, "_number": number})
    piece = F.when(F.col("_is_text"), escaped(F.col("_p.text"))).otherwise(
        F.concat(F.lit("<|"), name, F.lit("_"), F.col("_number").cast("string"), F.lit("|>"))
    )
    role = F.replace(escaped(F.col("_role")), F.lit("\n"), F.lit(LINE))
    head = F.when(F.col("_part") == 0, F.concat(F.lit(START), role, F.lit("\n"))).otherwise("")
    tail = F.when(F.col("_part") == F.col("_size") - 1, F.lit(f"{END}\n")).otherwise("")
    pieces = numbered.withColumns({"_piece": piece, "_head": head, "_tail": tail}).withColumn(
        "_chars", F.char_length(F.concat("_head", "_piece", "_tail")).cast("long")
    )
    begin = F.sum("_chars").over(so_far) - F.col("_chars") + F.char_length("_head")
    placed = pieces.withColumn("_begin", begin)

    span = F.when(
        F.col("_is_text") & (F.col("_role") == loss_role),
        F.struct(F.col("_begin").alias("begin"), F.char_length("_piece").cast("long").alias("length")),
    )
    attachment = F.when(
        ~F.col("_is_text"),
        F.struct(
            F.col("_number").alias("number"),
            kind.alias("kind"),
            F.col("_p.uri").alias("uri"),
            F.col("_no").cast("long").alias("turn"),
            F.col("_part").cast("long").alias("part"),
            F.col("_begin").alias("at"),
            media_tokens(F.col("_p"), patch, audio_rate, page_tokens).alias("tokens"),
        ),
    )
    # Turns first, then the conversation, so that the mask has one entry per turn.
    turns = placed.groupBy("_id", "_no").agg(
        F.sort_array(F.collect_list(F.struct("_part", F.concat("_head", "_piece", "_tail").alias("s")))).alias("s"),
        F.min(F.col("_begin") - F.char_length("_head")).alias("begin"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_list(attachment)).alias("found"),
    )
    turns = turns.select("_id", F.struct("_no", F.array_join(F.col("s.s"), "").alias("s"), "begin", "spans", "found").alias("t"))
    whole = turns.groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    shown = whole.select(
        F.col("_id").alias(id_col),
        F.array_join(F.col("t.s"), "").alias("formatted"),
        F.arrays_zip(F.col("t.begin").alias("begin"), F.col("t.spans").alias("spans")).alias("loss"),
        F.flatten(F.col("t.found")).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return shown.withColumn("media_tokens", total)


def read_turns(formatted: str = "formatted") -> Column:
    """Array of ``(role, text)`` of a formatted string, texts with their placeholders, unescaped."""
    marked = F.split(F.col(formatted), F.lit(r"\Q" + START + r"\E"), F.lit(-1))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.char_length(role) + 2)
        body = F.left(body, F.char_length(body) - len(END) - 1)
        return F.struct(
            unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text")
        )

    return F.transform(F.slice(marked, 2, F.size(marked)), turn)


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """Array of the texts under the mask, unescaped. Each span is looked up in its own turn, not in the whole string."""
    marked = F.split(F.col(formatted), F.lit(r"\Q" + START + r"\E"), F.lit(-1))
    turns = F.slice(marked, 2, F.size(marked))

    def spans(turn: Column, mask: Column) -> Column:
        before = mask["begin"] + len(START)
        return F.transform(
            mask["spans"],
            lambda s: unescaped(F.substr(turn, (s["begin"] - before + 1).cast("int"), s["length"].cast("int"))),
        )

    return F.flatten(F.zip_with(turns, F.col(loss), spans))
