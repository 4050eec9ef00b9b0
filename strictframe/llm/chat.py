"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything here is DataFrame expressions.  A conversation is one output value,
so its turns meet in one row: the work a task does for it is bounded by the
size of that value (Spark's 2 GB limit for one string), not by the table.

Defined cases: a null text or role is the empty string; turns are ordered by
``turn``, then role, then text, null turns first; repeated rows are kept as
further turns; a null conversation id is a conversation of its own; an empty
table gives an empty result; input columns beyond the four named ones are not
read; ties (turns of equal number) are ordered as just said; a very long text is
one part of its conversation's value.  An invalid order of roles is reported, never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How one role is shown, and whether its text counts for the loss."""

    name: str
    label: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative chat template.

    ``transitions`` is the state machine: state -> {role: next state}; a role
    that has no entry leads to the state ``error``, which has no way out.
    ``open``, ``separator`` and ``close`` surround label and text of a turn; the
    escapes of texts are derived from them.
    """

    roles: tuple[Role, ...] = (
        Role("system", "System"),
        Role("user", "User"),
        Role("assistant", "Assistant", loss=True),
    )
    open: str = "### "
    separator: str = ": "
    close: str = "</turn>\n"
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    #: Marks a label that stands for a role outside ``roles``.
    other: str = "="

    def __post_init__(self) -> None:
        """Reject a template whose marks a text could complete or forge in spite of the escapes."""
        labels = [r.label for r in self.roles]
        close, core = self.close, _core(self.close)
        marks = (self.open, self.separator, close, self.other, *labels)
        _check(self.separator and close and self.other and all("\\" not in m for m in marks), "separator, close and other must not be empty, and no mark may hold a backslash")
        _check(not (_border(close) or _border(core) or _border(self.separator)), "close or separator overlaps itself")
        opening = _core(self.open)
        _check(len(set(opening)) <= 1 or not _border(opening), "open overlaps itself")
        _check(len(set(labels)) == len(labels) and not any(x.startswith(self.other) for x in labels), "labels must differ, and not begin as those of other roles do")
        for x in labels:
            _check((x + self.separator).index(self.separator) == len(x), f"the separator ends the label {x} early")
        _check(self.separator not in self.other and not _meets(self.other, self.separator), "the separator may begin in the mark of other roles")
        # Texts hold no core of the close mark; a close mark must not arise across the edge of a text either.
        heads = [self.open + x + self.separator for x in labels] + [self.open + self.other, self.separator]
        cuts = [k for k in range(1, len(close)) if core not in close[:k] and core not in close[k:]]
        for h in heads:
            _check(close not in h and not any(h.endswith(close[:k]) for k in cuts), f"a close mark may arise behind {h!r}")
        _check(not any(self.separator.startswith(close[k:]) or close[k:].startswith(self.separator) for k in cuts), "a close mark may arise across the separator")

    def escapes(self, label: bool = False) -> tuple[list[tuple[str, str]], dict[str, str]]:
        """What is replaced in a text (or a label) in turn, and the code of each mark of one character.

        A backslash is doubled.  A mark of several characters gets a backslash
        behind its first one; where it repeats one character, each gets one
        before it.  A mark of one character becomes a backslash and a letter.
        """
        marks = [m for m in dict.fromkeys([_core(self.open), _core(self.close), *([self.separator] if label else [])]) if m]
        single = [m for m in marks if len(m) == 1]
        taken = {c for m in marks for c in m[:2]}
        free = [c for c in "snrtbxyzuvwklmpqdfghacejio0123456789" if c not in taken]
        codes = dict(zip(single, free))
        steps = [("\\", "\\\\"), *((m, "\\" + c) for m, c in codes.items())]
        for m in marks:
            if len(m) > 1:
                steps.append((m[0], "\\" + m[0]) if len(set(m)) == 1 else (m, m[0] + "\\" + m[1:]))
        return steps, codes


def _core(mark: str) -> str:
    """A mark without white space around it; texts are kept clear of that much of it."""
    return mark.strip() or mark


def _border(mark: str) -> bool:
    """Whether two occurrences of a mark can overlap."""
    return any(mark[:k] == mark[-k:] for k in range(1, len(mark)))


def _meets(before: str, mark: str) -> bool:
    """Whether a mark can begin at the end of what stands before."""
    return any(before.endswith(mark[:k]) for k in range(1, len(mark)))


def _check(good: object, message: str) -> None:
    if not good:
        raise ValueError(message)


def escape(text: Column, template: ChatTemplate | None = None, label: bool = False) -> Column:
    """Make the template's control strings impossible inside a text; ``unescape`` is the inverse.

    Each backslash in the result starts a pair.
    """
    for mark, shown in (template or ChatTemplate()).escapes(label)[0]:
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def unescape(text: Column, template: ChatTemplate | None = None, label: bool = False) -> Column:
    out = text
    for mark, code in (template or ChatTemplate()).escapes(label)[1].items():
        # A code stands behind a backslash that starts a pair: one with an even number of them before it.
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\" + code, "$1" + mark.replace("$", "\\$"))
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(out, r"(?s)\\(.)", "$1")).otherwise(text)


def _label(role: Column, t: ChatTemplate) -> Column:
    out = F.concat(F.lit(t.other), escape(role, t, label=True))
    for r in reversed(t.roles):
        out = F.when(role == r.name, F.lit(r.label)).otherwise(out)
    return out


def _role(label: Column, t: ChatTemplate) -> Column:
    out = unescape(F.substr(label, F.lit(len(t.other) + 1)), t, label=True)
    for r in reversed(t.roles):
        out = F.when(label == r.label, F.lit(r.name)).otherwise(out)
    return out


def _any(role: Column, names: list[str]) -> Column:
    return role.isin(names) if names else F.lit(False)


def _step(state: Column, role: Column, t: ChatTemplate) -> Column:
    out = F.lit("error")
    for s, row in t.transitions.items():
        for r, to in row.items():
            out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
    return out


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row a conversation: its id, ``n_turns``, ``end_state``, ``valid``, ``segments``, ``formatted``.

    ``segments`` is an array of (text, loss) whose texts joined are
    ``formatted``; a text segment of a role with ``loss`` carries the flag.
    """
    t = template or ChatTemplate()
    losing = [r.name for r in t.roles if r.loss]
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    grouped = (
        turns.select(F.col(conversation), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
        .groupBy(conversation)
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.separator)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), _any(x["role"], losing).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    end = F.aggregate("turns", F.lit(t.start), lambda s, x: _step(s, x["role"], t))
    return (
        grouped.select(conversation, F.size("turns").cast("long").alias("n_turns"), end.alias("end_state"), segments.alias("segments"))
        .withColumn("valid", F.col("end_state").isin(list(t.accept)))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def parse_chats(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, read back exactly."""
    t = template or ChatTemplate()
    # split() takes a pattern; the close mark is quoted, and -1 keeps empty tails.
    blocks = F.split(formatted, "\\Q" + t.close + "\\E", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def one(block: Column) -> Column:
        label = F.substring_index(F.substr(block, F.lit(len(t.open) + 1)), t.separator, 1)
        body = F.substr(block, F.char_length(label) + len(t.open) + len(t.separator) + 1)
        return F.struct(_role(label, t).alias("role"), unescape(body, t).alias("text"))

    return F.transform(blocks, one)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")


def chat_digests(turns: DataFrame, template: ChatTemplate | None = None, conversation: str = "conv_id") -> DataFrame:
    """Digests of what ``format_chats`` wrote, computed from its output alone."""
    out = format_chats(turns, template, conversation)
    read = out.select(
        conversation,
        parse_chats(F.col("formatted"), template).alias("read"),
        loss_text(F.col("segments"), template).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "end_state",
    )
    joined = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        conversation,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "end_state",
    )
