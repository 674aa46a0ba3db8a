"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template gives the marks around a turn, the roles under the loss mask and the transitions of the machine. Formatting
emits text segments with a loss flag each; texts and roles are escaped so that no control string of the template can
arise in them, and reading back undoes it.

Escapes, fixed: a backslash is doubled, then "<|" becomes "<\\|"; in roles a newline becomes "<\\!" also. Every single
backslash in escaped text is thus one that escaping put in, which makes the reverse unique.

A conversation is one row of output, so its turns are gathered by conv_id; that group is the record itself. Defined
results: null text or role is empty (an empty role is in no transition, so such a conversation is invalid); turns are
ordered by turn, role, text, so ties and repeated rows have a fixed order and are all kept; a null conv_id is one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import let


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\!"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\!"), F.lit("\n")))


def final_state(turns: Column, template: ChatTemplate) -> Column:
    """The machine's state after all turns; "error" once a turn has no transition."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(turns, F.lit(template.start), lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit("error")))


def segments_of(turns: Column, template: ChatTemplate) -> Column:
    """Three segments a turn: its opening marks, its escaped text, its closing mark."""
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.role_end)), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )


def format_conversations(rows: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """conv_id, valid, state, segments (text, loss) and formatted of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = whole.select("conv_id", final_state(F.col("turns"), template).alias("state"), segments_of(F.col("turns"), template).alias("segments"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select("conv_id", F.col("state").isin(*template.accept).alias("valid"), "state", "segments", text.alias("formatted"))


def read_turns(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = let(F.split(formatted, "\\Q" + template.open + "\\E"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))

    def turn(part: Column) -> Column:
        head = F.instr(part, template.role_end)
        body = F.substring(part, head + len(template.role_end), F.length(part) - head - (len(template.role_end) - 1) - len(template.close))
        return F.struct(unescape_role(F.substring(part, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(formatted: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """The digests of what the output holds."""
    read = formatted.select("conv_id", "valid", "formatted", read_turns(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
