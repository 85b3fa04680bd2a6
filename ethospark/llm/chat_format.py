"""Chat formatting: turns of a conversation → one text with a loss mask, from a declarative template.

``TEMPLATE`` names, per role, the control strings around a turn and whether its text bears loss;
``TRANSITIONS`` is the machine over roles that says which order of turns is valid. Control strings
inside a text (or a role) are escaped: every backslash is doubled, then a backslash goes behind the
first character of each control string, so none is left; ``read_back`` undoes both. Only DataFrame
functions.

Scale: one shuffle on the conversation id. A conversation is one output record, so its turns meet
in one row; nothing else does.

Defined cases: a null text or role is empty; roles outside the template are written with their name;
turns with the same number are ordered by role, then text; a null turn number comes first; rows with
a null conversation id are one conversation. Invalid orders are formatted too, with ``valid`` false.
An empty table gives an empty table; columns other than the four named ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
    "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
    "assistant": {"open": "<s>", "close": "</s>", "loss": True},
}
#: A role without an entry: open, its name, then its text, close.
OTHER = {"open": "[ROLE]", "then": "[TEXT]", "close": "[/ROLE]", "loss": False}
#: state → roles that may follow; the state is the last role
TRANSITIONS = {
    "start": ["system", "user"],
    "system": ["user"],
    "user": ["assistant"],
    "assistant": ["user"],
}
ACCEPT = ["user", "assistant"]


def _controls(template: dict, other: dict) -> list[str]:
    parts = [p[k] for p in (*template.values(), other) for k in ("open", "then", "close") if k in p]
    if any(len(c) < 2 or "\\" in c for c in parts) or len(set(parts)) < len(parts):
        raise ValueError("control strings must differ, have two characters and no backslash")
    return parts


def escape(text: Column, controls: list[str]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column, controls: list[str]) -> Column:
    for c in controls:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _by_role(role: Column, template: dict, key: str, other: Column) -> Column:
    found = other
    for name, part in template.items():
        found = F.when(role == name, F.lit(part[key])).otherwise(found)
    return found


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: dict = TEMPLATE, other: dict = OTHER, transitions: dict = TRANSITIONS, accept: list[str] = ACCEPT,
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``segments`` [(text, loss)], ``valid``,
    ``final_state``. The segments' texts follow each other without gap and make up ``formatted``."""
    controls = _controls(template, other)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    grouped = (
        turns.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
        .groupBy(conv)
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )

    def segments(t: Column) -> Column:
        named = F.concat(F.lit(other["open"]), escape(t.role, controls), F.lit(other["then"]))
        pieces = [
            (_by_role(t.role, template, "open", named), F.lit(False)),
            (escape(t.text, controls), _by_role(t.role, template, "loss", F.lit(other["loss"]))),
            (_by_role(t.role, template, "close", F.lit(other["close"])), F.lit(False)),
        ]
        return F.array(*[F.struct(x.alias("text"), loss.alias("loss")) for x, loss in pieces])

    arcs = F.create_map(*[F.lit(x) for s, roles in transitions.items() for r in roles for x in (f"{s}>{r}", r)])
    final = F.aggregate(
        F.transform("turns", lambda t: t.role), F.lit("start"),
        lambda state, r: F.coalesce(F.try_element_at(arcs, F.concat_ws(">", state, r)), F.lit("invalid")),
    )
    made = grouped.select(conv, F.flatten(F.transform("turns", segments)).alias("segments"), final.alias("final_state"))
    return made.select(
        conv, F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments",
        F.col("final_state").isin(accept).alias("valid"), "final_state",
    )


def read_back(formatted: Column, template: dict = TEMPLATE, other: dict = OTHER) -> Column:
    """``formatted`` → [(role, text, loss)], the escapes undone."""
    controls = _controls(template, other)
    quoted = lambda c: "\\Q" + c + "\\E"
    opens = "|".join(quoted(p["open"]) for p in (*template.values(), other))
    parts = F.filter(F.split(formatted, f"(?={opens})"), lambda p: p != "")

    def inner(p: Column, begin: str, close: str) -> Column:
        return F.substring(p, F.lit(len(begin) + 1), F.char_length(p) - len(begin) - len(close))

    def turn(p: Column) -> Column:
        body = inner(p, other["open"], other["close"])
        found = F.struct(
            unescape(F.substring_index(body, other["then"], 1), controls).alias("role"),
            unescape(F.substring_index(body, other["then"], -1), controls).alias("text"),
            F.lit(other["loss"]).alias("loss"),
        )
        for name, part in template.items():
            own = F.struct(
                F.lit(name).alias("role"),
                unescape(inner(p, part["open"], part["close"]), controls).alias("text"),
                F.lit(part["loss"]).alias("loss"),
            )
            found = F.when(p.startswith(part["open"]), own).otherwise(found)
        return found

    return F.transform(parts, turn)
