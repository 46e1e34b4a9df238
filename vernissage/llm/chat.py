"""Chat formatting: a role automaton, a declarative template, text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm.text import fixed_partitions

_ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """What stands around a turn's text, and whether the text counts for the loss."""

    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A chat format.

    `turns` has the known roles. A turn of any other role is marked by
    `role_open`, its name, `role_close` and ended by `role_end`. `controls` are
    all strings that may not occur inside texts. `follow` has the roles allowed
    after each role, and first in a conversation under the empty name.
    """

    begin: str
    turns: Mapping[str, Turn]
    controls: tuple[str, ...]
    follow: Mapping[str, tuple[str, ...]]
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    role_end: str = "[END]"
    _starts: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or _ESCAPE in c:
                raise ValueError(f"control {c!r} is too short or holds the escape character")
            if any(c.startswith(c[-n:]) for n in range(1, len(c))):
                raise ValueError(f"control {c!r} begins as it ends, so its place would be unclear")
        for text in (self.role_close, self.role_end, *(t.suffix for t in self.turns.values())):
            if not any(c in text for c in self.controls):
                raise ValueError(f"{text!r} holds no control string")
        alternatives = "|".join(map(re.escape, self.controls))
        object.__setattr__(self, "_starts", re.compile(rf"\\|(?=(?:{alternatives}))[\s\S]"))

    def escape(self, text: str) -> str:
        """Doubles the escape character and sets one behind the first character of every control."""
        return self._starts.sub(lambda m: m[0] + _ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """(text, counts for the loss) of one turn."""
        turn = self.turns.get(role)
        if turn is None:
            turn = Turn(f"{self.role_open}{self.escape(role)}{self.role_close}", self.role_end)
        return [((self.begin if first else "") + turn.prefix, False), (self.escape(text), turn.loss), (turn.suffix, False)]

    def parse(self, text: str, first: bool) -> tuple[str, str]:
        """(role, text) of one formatted turn; the reverse of the joined segments."""
        if first:
            if not text.startswith(self.begin):
                raise ValueError("a conversation does not start with its marker")
            text = text[len(self.begin) :]
        if text.startswith(self.role_open):
            name, _, rest = text[len(self.role_open) :].partition(self.role_close)
            return self.unescape(name), self.unescape(self._until(rest, self.role_end))
        for role, turn in self.turns.items():
            if text.startswith(turn.prefix):
                return role, self.unescape(self._until(text[len(turn.prefix) :], turn.suffix))
        raise ValueError("a turn starts with no known marker")

    @staticmethod
    def _until(text: str, suffix: str) -> str:
        at = text.find(suffix)
        if at < 0 or at + len(suffix) != len(text):
            raise ValueError("a turn does not end with its marker")
        return text[:at]


DEFAULT = Template(
    begin="<s>",
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[OUT] ", "</s>", loss=True),
    },
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]"),
    follow={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)

_FORMATTED = "turn bigint, first boolean, allowed boolean, segments array<struct<text:string,loss:boolean>>"
_READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conversation, state = False, None, ""
        for batch in batches:
            firsts, allowed, segments = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                first = not started or conv != conversation
                if first:
                    started, conversation, state = True, conv, ""
                firsts.append(first)
                allowed.append(role in template.follow.get(state, ()))
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text, first)])
                state = role
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pa.array(firsts, pa.bool_()), pa.array(allowed, pa.bool_()), pa.array(segments, kind)],
                names=["conv", "turn", "first", "allowed", "segments"],
            )

    return run


def format_conversations(conversations: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """(key, turn, first, allowed, segments) per turn, each conversation in one partition and in order.

    The automaton's state is the role of the turn before; `allowed` says whether
    the turn may follow. Turns out of order are formatted all the same. Rows are
    sorted by turn (null first), then role and text, and stream through a task
    one by one, so memory does not depend on the length of a conversation.

    Null texts and roles are empty, a role without an entry in the template is
    written by name. Repeated rows are repeated turns. A null key is a
    conversation of its own. Extra columns are ignored, and an empty table gives
    no rows.
    """
    rows = conversations.select(
        F.col(key).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = fixed_partitions(rows, "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(_formatter(template), f"conv {kind}, {_FORMATTED}").withColumnRenamed("conv", key)


class _Reading:
    """What has been read of one conversation so far."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.valid = conv, 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _reader(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = None, None

        def out(rows):
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, first, allowed, segments in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if first:
                    if held is not None:
                        done.append(held.row())
                    held = _Reading(conv)
                whole = "".join(s["text"] for s in segments)
                role, text = template.parse(whole, first)
                masked = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                held.turns += 1
                held.valid &= allowed
                held.chars += len(whole)
                held.loss_chars += len(masked)
                held.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                held.loss.update(masked.encode("utf-8", "surrogatepass"))
            if done:
                yield out(done)
        if held is not None:
            yield out([held.row()])

    return run


def read_back(formatted: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """Digests per conversation, parsed from formatted turns as `format_conversations` leaves them."""
    rows = formatted.select(F.col(key).alias("conv"), "turn", "first", "allowed", "segments")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(_reader(template), f"conv {kind}, {_READ}").withColumnRenamed("conv", key)
