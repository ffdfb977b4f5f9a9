"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered as `<|im_start|>role`, a line break, the text and `<|im_end|>`, a line break.
The rendered conversation is parsed again by the grammar below; if the turns that come back are
not the turns that went in, the conversation's texts are escaped and rendered anew. Escaping adds
one backslash inside any `<|` (or `<\\|`, `<\\\\|`, ...) of a text, so no mark can occur in it, and
parsing takes one away: text that holds no such string is written as it is.

Null text and null role are empty. A null conversation id is a conversation of its own, as any
other. Rows go by turn (nulls first), equal turns by role, then text; repeated rows stay repeated.
Each conversation is one row of the result by definition, so its turns meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line break inside a role; cannot come from an escaped text.
BREAK = "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(turns: Column, escaped: bool) -> Column:
    """One string from an array of (role, text)."""

    def one(t: Column) -> Column:
        role, text = (escape(t["role"]), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(START), F.replace(role, F.lit("\n"), F.lit(BREAK)), F.lit("\n"), text, F.lit(f"{END}\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a rendered string stands for; null if it breaks the grammar.

    Grammar: (START role NEWLINE text END NEWLINE)*, no mark inside a role or a text."""
    quoted = START.replace("|", r"\|")
    pieces = F.split(formatted, quoted)
    parts = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    tail = len(END) + 1

    def good(p: Column) -> Column:
        return p.endswith(f"{END}\n") & p.contains("\n") & (F.instr(p, END) == F.length(p) - tail + 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - tail)
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    whole = (formatted == "") | formatted.startswith(START)
    return F.when(whole & F.forall(parts, good), F.transform(parts, turn))


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, escaped, round_trip): one row for each conversation.

    `turns` is parsed from `formatted`; `round_trip` says that it equals the source."""
    source = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(source)).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("plain", render(F.col("source"), escaped=False))
    chats = chats.withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True)).otherwise(F.col("plain")))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    return chats.select("conv_id", "formatted", "turns", "escaped", F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask: the answers, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
