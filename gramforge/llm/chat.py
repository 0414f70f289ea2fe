"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: `message` (a turn starts: role and text), `delta` (more text of a turn), `edit` (the
turn's text is replaced) and `regenerate` (the turn starts anew and later turns go). Logs are dealt out by conversation,
sorted by sequence number and folded into the final messages; these are rendered with a template whose control strings
cannot occur in an escaped text, together with the spans of assistant text that count for the loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Characters that control strings start with, `&` first; a role cannot hold a line break either.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def escaped(c: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def unescaped(c: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), pairs[::-1], c)


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages (conv, turn, role, text) of a log. A null text is empty, a null kind a message, a null role the
    turn's last known role, or empty; a null turn comes before all others, null conversations make one. Events with one
    sequence number follow each other by kind and text. Regenerating a turn drops what it held and all later turns' events
    until then. One shuffle, by conversation."""
    e = events.select(F.col(conv).alias("_c"), F.col(seq).cast("long").alias("_q"), F.coalesce(F.col(kind), F.lit("message")).alias("_k"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("_t"), F.col(role).cast("string").alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    own, before = Window.partitionBy("_c", "_t"), Window.partitionBy("_c").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    again = F.when(F.col("_k") == "regenerate", F.col("_q"))
    e = e.withColumn("_cut", F.max(again).over(before)).withColumn("_role", F.max(F.when(F.col("_r").isNotNull(), F.struct("_q", "_r"))).over(own)["_r"])
    live = e.filter("_cut is null or _q > _cut").withColumn("_start", F.max(F.when(F.col("_k") != "delta", F.col("_q"))).over(own)).filter("_start is null or _q >= _start")
    parts = F.array_sort(F.collect_list(F.struct("_q", F.when(F.col("_k") == "delta", 1).otherwise(0).alias("_d"), "_x")))
    # of several starts with one sequence number the last one counts
    first = F.coalesce(F.array_max(F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p["_d"].alias("d"), i.alias("i"))), lambda p: p["d"] == 0), lambda p: p["i"])), F.lit(0))
    whole = live.groupBy("_c", "_t").agg(F.max("_role").alias("_role"), parts.alias("_p"), first.alias("_f"))
    return whole.select(F.col("_c").alias(conv), F.when(F.col("_t") != -(1 << 62), F.col("_t")).alias(turn), F.coalesce("_role", F.lit("")).alias(role), F.array_join(F.transform(F.slice("_p", F.col("_f") + 1, F.size("_p")), lambda p: p["_x"]), "").alias(text))


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, formatted, and loss_spans: start and length, in characters of `formatted`, of
    each assistant text, in order. A conversation has to fit in a row."""
    lines = messages.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("")).alias("_role"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("_x"))
    lines = lines.withColumn("_head", F.concat(F.lit(TURN), escaped(F.col("_role"), ROLE_ESCAPES), F.lit("\n")))
    lines = lines.withColumn("_piece", F.concat("_head", "_x", F.lit(END)))
    so_far = Window.partitionBy("_c").orderBy("_t", "_role", "_x").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(so_far), F.lit(0)))
    span = F.when(F.col("_role") == "assistant", F.struct((F.col("_at") + F.length("_head")).cast("int").alias("start"), F.length("_x").alias("length")))
    whole = lines.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece", span.alias("_span")))).alias("_l"))
    return whole.select(F.col("_c").alias(conv), F.array_join(F.transform("_l", lambda x: x["_piece"]), "").alias("formatted"), F.filter(F.transform("_l", lambda x: x["_span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (array of role and text) and loss_text, read from `formatted` and `loss_spans` alone."""
    pieces = F.split("formatted", "<\\|end\\|>\n", -1)
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(TURN) + 1, 1 << 30))
    turns = F.transform(bodies, lambda b: F.struct(unescaped(F.substring_index(b, "\n", 1), ROLE_ESCAPES).alias("role"), unescaped(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select(conv, turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    back = read_back(formatted, conv)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Sequence numbers between the first events of two turns.
STEP = 8


def log_of(rows: DataFrame) -> DataFrame:
    """A table of conversations as the log that a chat server would have written: conv_id, seq, kind, turn, role, text. A
    row's place among its conversation's rows (by turn, then role and text, so that repeated rows stay) is its turn. Texts
    arrive in two parts. By place, turns are streamed (a message and deltas), edited (a draft that an edit replaces, a delta
    after it) or regenerated: a draft and a turn that follows it, both of which the new attempt drops."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    own = rows.select("conv_id", place.alias("_p"), "role", F.coalesce(F.col("text"), F.lit("")).alias("_x"), "turn", "text")
    half = F.floor(F.length("_x") / 2).cast("int")
    first, second = F.substr("_x", F.lit(1), half), F.substr("_x", half + 1)
    none = F.lit(None).cast("string")

    def event(step: int, kind: str, text: Column, role: Column = none, later: int = 0) -> Column:
        return F.struct((F.col("_p") * STEP + step).alias("seq"), F.lit(kind).alias("kind"), (F.col("_p") + later).alias("turn"), role.alias("role"), text.alias("text"))

    draft = F.concat(F.lit("draft of "), "_x")
    streamed = F.array(event(0, "message", F.lit(""), F.col("role")), event(1, "delta", first), event(2, "delta", second))
    edited = F.array(event(0, "message", draft, F.col("role")), event(1, "edit", first), event(2, "delta", second))
    again = F.array(event(0, "message", draft, F.col("role")), event(1, "delta", F.lit(" goes")), event(2, "message", draft, later=1), event(3, "regenerate", first, F.col("role")), event(4, "delta", second))
    kind = F.col("_p") % 3
    return own.select("conv_id", F.explode(F.when(kind == 1, streamed).when(kind == 2, again).otherwise(edited)).alias("_e")).select("conv_id", "_e.*")
