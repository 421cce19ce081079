"""Chat formatting with a grammar round trip, in DataFrame operations only.

A turn is rendered, read back by a deterministic parser and compared with its source; where they differ (a text holds
a control string, or something that reads as an escape) the turn is rendered escaped.  The formatted conversation is
parsed as a whole again, and what callers get (turns, loss text) is read from the formatted text.

Grammar of a conversation: ``<s>`` before each turn, then ``[INST]text[/INST]`` for user, ``<<SYS>>text<</SYS>>`` for
system, ``text</s>`` for assistant and ``[ROLE name]text[/ROLE]`` for any other role; a text holds no control string.

Edge cases: null text and null role count as empty; turns of equal number are ordered by role and text; repeated rows
are repeated turns; a null conversation id is a conversation of its own; very long texts stay whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template, by role.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
START, ROLE, ROLE_END = "<s>", "[ROLE ", "[/ROLE]"
CONTROL = [START, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", ROLE, ROLE_END]
#: Escapes: the backslash first when written, last when read.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\i"), ("]", "\\j"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _holds_control(text: Column) -> Column:
    found = F.lit(False)
    for mark in CONTROL:
        found = found | F.contains(text, F.lit(mark))
    return found


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(START + ROLE), role, F.lit("]"), text, F.lit(ROLE_END))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(START + a), text, F.lit(b))).otherwise(out)
    return out


def parse_turn(turn: Column) -> Column:
    """Role and text of what follows a ``<s>``; null where the grammar does not hold."""

    def body(a: str, b: str) -> Column:
        return F.substring(turn, F.lit(len(a) + 1), F.length(turn) - (len(a) + len(b)))

    def is_(a: str, b: str) -> Column:
        return F.startswith(turn, F.lit(a)) & F.endswith(turn, F.lit(b)) & (F.length(turn) >= len(a) + len(b))

    def read(role: Column, text: Column) -> Column:
        return F.when(~_holds_control(text), F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    inner = body(ROLE, ROLE_END)
    cut = F.instr(inner, "]")
    other = F.when(cut > 0, read(F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + 1, F.length(inner))))
    out = F.when(is_(*MARKS["user"]), read(F.lit("user"), body(*MARKS["user"])))
    out = out.when(is_(*MARKS["system"]), read(F.lit("system"), body(*MARKS["system"])))
    return out.when(is_(ROLE, ROLE_END), other).when(is_(*MARKS["assistant"]), read(F.lit("assistant"), body(*MARKS["assistant"])))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, START)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), parse_turn)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, turns (array of role and text, read back from formatted) and
    loss_spans (array of start and end, in code points of formatted, of the assistant texts as they stand there)."""
    df = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    back = parse_turn(F.substring(F.col("plain"), F.lit(len(START) + 1), F.length("plain")))
    df = df.withColumn("plain", plain).withColumn("back", back)
    same = F.coalesce((F.col("back.role") == F.col("role")) & (F.col("back.text") == F.col("text")), F.lit(False))
    safe_role = F.when(F.col("role").isin(*MARKS), F.col("role")).otherwise(escape(F.col("role")))
    df = df.select("conv", "turn", "role", "text", F.when(same, F.col("plain")).otherwise(render_turn(safe_role, escape(F.col("text")))).alias("out"))
    whole = df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out"))).alias("own"))
    whole = whole.select("conv", F.array_join("own.out", "").alias("formatted"))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    lengths = F.transform(F.split("formatted", START), lambda t: F.struct(F.length(t).alias("n"), F.endswith(t, F.lit(MARKS["assistant"][1])).alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + len(START) + x["n"]
        span = F.struct((acc["at"] + len(START)).alias("start"), (end - len(MARKS["assistant"][1])).alias("end"))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(F.slice(lengths, F.lit(2), F.size(lengths)), start, step, lambda acc: acc["spans"])
    return whole.select(F.col("conv").alias(conv_col), "formatted", "turns", spans.alias("loss_spans"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What op10 returns, read back from formatted conversations."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    df = formatted.withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), ""))
    return df.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
