"""Chat formatting with turn structs and Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template. Each begins with < or [ and has neither of them, nor a backslash, further on.
BEGIN, END = "<s>", "</s>"
OPEN, ROLE, TURN, CLOSE = "[INST]", "<|text|>", "<|turn|>", "[/INST]"
_AFTER_FIRST = r"(/?s>|/?INST\]|\|text\|>|\|turn\|>)"


def escape(text: Column) -> Column:
    """One backslash more after the first character of every control string, however many there are."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _AFTER_FIRST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undo `escape`."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _AFTER_FIRST, "$1$2$3")


def _let(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def format_chats(turns: DataFrame, trained: tuple = ("assistant",)) -> DataFrame:
    """(conv_id, pieces, formatted): one row per conversation.

    `formatted` is the text; `pieces`, an array of (text, loss), is the same text cut up, with loss true on
    the texts of the roles in `trained`, so the loss mask is by piece. Turns are in order of turn, null last,
    then role, then text; neighbours of one role share one block, parted by a turn mark. Null role or text:
    empty. Repeated rows are turns of their own. A null conv_id is a conversation. The rows of a conversation
    meet in one task because the result is one row for it."""
    row = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pieces(t: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            joins = (i > 0) & (F.get(t, i - 1)["role"] == x["role"])
            head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(x["role"]), F.lit(ROLE))
            mark = F.struct(F.when(joins, F.lit(TURN)).otherwise(head).alias("text"), F.lit(False).alias("loss"))
            return F.array(mark, F.struct(escape(x["text"]).alias("text"), x["role"].isin(*trained).alias("loss")))

        edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
        return F.concat(edge(BEGIN), F.flatten(F.transform(t, piece)), edge(CLOSE + END))

    chats = chats.select("conv_id", _let(F.col("turns"), pieces).alias("pieces"))
    return chats.select("conv_id", "pieces", F.array_join(F.col("pieces")["text"], "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), from a formatted text."""

    def turns(block: Column) -> Column:
        halves = F.split(block, r"<\|text\|>", 2)
        role = unescape(F.element_at(halves, 1))
        texts = F.split(F.element_at(halves, 2), r"<\|turn\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    body = F.substring(formatted, F.lit(len(BEGIN + OPEN) + 1), F.char_length(formatted) - len(BEGIN + OPEN + CLOSE + END))
    return F.flatten(F.transform(F.split(body, r"\[/INST\]\[INST\]"), turns))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
