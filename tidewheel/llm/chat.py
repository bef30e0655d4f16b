"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Which role may follow which state; the state after a turn is that turn's role.
TURN_ORDER: dict[str, tuple[str, ...]] = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user", "tool"),
    "tool": ("assistant", "tool"),
}


@dataclass(frozen=True)
class ChatTemplate:
    """turn_start role role_end text turn_end, for every turn. Control strings begin with '<|'.

    Inside roles and texts each run '<', backslashes, '|' gets one backslash more, so neither can
    hold '<|'; a line feed inside a role becomes newline_in_role. Both are undone by parse().
    """

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    newline_in_role: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: TURN_ORDER)

    def __post_init__(self) -> None:
        for control in (self.turn_start, self.turn_end, self.newline_in_role):
            if not control.startswith("<|"):
                raise ValueError(f"control string {control!r} must begin with '<|'")
        if self.role_end != "\n":
            raise ValueError("role_end must be a line feed")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _state_after(state: Column, role: Column, template: ChatTemplate) -> Column:
    moves = F.create_map(*[F.lit(x) for a, to in template.order.items() for b in to for x in (f"{a}>{b}", b)])
    return F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("invalid"))


def format_chat(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, complete, segments, formatted.

    segments is array<struct<text, loss>> in output order; formatted is their concatenation. The
    state machine runs over the roles: valid is false if a turn's role may not follow the turn
    before it (also for roles the template doesn't know); complete is true if, besides, the last
    turn bears loss. Conversations that break the order are formatted too, for the caller to drop.

    Null roles and texts count as empty; the null conversation is a conversation. Turns with the
    same number go by role, then text; a null turn number comes first; repeated rows stay. An empty
    table gives none. Columns besides the four are not read. A conversation is one row of output
    and so is gathered in one task; nothing larger is.
    """
    template = template or ChatTemplate()
    source = turns.select(
        F.col(quoted(conv_col)).alias("conv_id"),
        F.struct(
            F.col(quoted(turn_col)).alias("turn"),
            F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"),
            F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(turn: Column) -> Column:
        role = F.regexp_replace(escape(turn["role"]), "\n", template.newline_in_role.replace("\\", "\\\\").replace("$", "\\$"))
        head = F.concat(F.lit(template.turn_start), role, F.lit(template.role_end))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(head, F.lit(False)),
            part(escape(turn["text"]), turn["role"].isin(*template.loss_roles)),
            part(F.lit(template.turn_end), F.lit(False)),
        )

    out = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit("start"), lambda state, t: _state_after(state, t["role"], template)).alias("last_state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        (F.col("last_state") != "invalid").alias("valid"),
        F.col("last_state").isin(*template.loss_roles).alias("complete"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns, array<struct<role, text>>, read back from a formatted conversation."""
    template = template or ChatTemplate()
    pieces = F.split(formatted, "\\Q" + template.turn_start + "\\E", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.role_end, 1)
        at = F.length(role) + len(template.role_end)
        body = F.substring(piece, at + 1, F.length(piece) - at - len(template.turn_end))
        plain = unescape(F.replace(role, F.lit(template.newline_in_role), F.lit("\n")))
        return F.struct(plain.alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask, nothing between segments."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
