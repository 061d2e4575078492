"""Chat formatting whose output is parsed back and proven equal to its source.

Rendering is turn by turn: every turn is one segment

    ``[INST:role] text [/INST]``   for a turn without loss
    ``[ASST:role] text </s>``      for a turn under the loss mask

with a line feed after each segment.  The grammar is deterministic: a segment
is an opening mark with a role, a body without any control string, and the
closing mark of its kind.  A role or body that would conflict (it holds a
control string, or an escape mark) is escaped reversibly: the escape mark is
U+241B, and the first character of every control string found in the content is
written as escape mark + ``0`` + code point in hex + ``;``.  After rendering, each segment is
parsed again and compared with its source turn; while they differ, the content
is escaped more widely (every character that any control string begins with,
then every character), so what is written always reads back identical.

Order of turns: turn (null first), then the segment itself.  Defined results: null
role or text is the empty string; repeated turns stay; an empty table gives no
rows; other columns are ignored.  A conversation of any size is a run of
segments in order, never one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "␛"
# Control strings of the template and of its usual relatives (fixed values).
CONTROLS = ["<s>", "</s>", "[INST", "[/INST]", "[ASST", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|startoftext|>", "<|endoftext|>"]
LOSS_ROLES = ("assistant",)

_CONFLICT = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + f"|{ESCAPE}")
_WIDER = re.compile("[" + re.escape("".join(sorted({c[0] for c in CONTROLS}))) + f"\\]{ESCAPE}]")
_ALL = re.compile(r"[\s\S]")
_UNESCAPE = re.compile(f"{ESCAPE}0([0-9a-f]+);")
_SEGMENT = re.compile(r"\[(INST|ASST):([^\]]*)\] ([\s\S]*?)( \[/INST\]| </s>)\n")


def _code(ch: str) -> str:
    return f"{ESCAPE}0{ord(ch):x};"


def escape(text: str, level: int = 0) -> str:
    """Escape the conflicting parts of a content string; higher levels escape more."""
    rule = (_CONFLICT, _WIDER, _ALL)[level]
    if level == 0:
        return rule.sub(lambda m: _code(m.group()[0]) + m.group()[1:], text)
    return rule.sub(lambda m: _code(m.group()), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text) if ESCAPE in text else text


def render(role: str, text: str, loss: bool, level: int = 0) -> str:
    mark, close = ("ASST", " </s>") if loss else ("INST", " [/INST]")
    name = escape(role, level).replace("]", _code("]"))
    return f"[{mark}:{name}] {escape(text, level)}{close}\n"


def parse(formatted: str) -> list[tuple[str, str, bool, int, int]]:
    """Turns of formatted text: (role, text, under loss, start and end of the body).

    Raises ValueError where the text doesn't follow the grammar.
    """
    turns, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None or (m.group(1) == "ASST") != (m.group(4) == " </s>"):
            raise ValueError(f"no segment at {at}")
        turns.append((unescape(m.group(2)), unescape(m.group(3)), m.group(1) == "ASST", m.start(3), m.end(3)))
        at = m.end()
    return turns


def round_trip(role: str, text: str, loss: bool) -> tuple[str, int, int]:
    """A segment that parses back to exactly this turn, and the span of its body."""
    for level in range(3):
        segment = render(role, text, loss, level)
        try:
            turns = parse(segment)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:3] == (role, text, loss):
            return segment, turns[0][3], turns[0][4]
    raise ValueError("a turn can't be written so that it reads back")


FORMATTED = "conv_id long, turn long, segment string, loss_start int, loss_end int"


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One proven segment per turn, with the loss span inside it (-1 where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, ends = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                loss = role in loss_roles
                segment, a, b = round_trip(role or "", text or "", loss)
                segments.append(segment)
                starts.append(a if loss else -1)
                ends.append(b if loss else -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(segments, pa.string()),
                 pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["conv_id", "turn", "segment", "loss_start", "loss_end"])

    own = turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
                       turns[role_col].alias("role"), turns[text_col].alias("text"))
    return own.mapInArrow(run, FORMATTED)


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


class _Digest:
    """What is read back of one conversation, a segment at a time."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        for role, text, under_loss, a, b in parse(segment):
            if under_loss != (start >= 0) or under_loss and (a, b) != (start, end):
                raise ValueError("the loss mask and the grammar disagree")
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start >= 0:
            masked = unescape(segment[start:end])
            self.loss += len(masked)
            self.masked.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from its segments in order.

    A digest of text in order is sequential by nature: one task streams one
    conversation's segments and holds only the running digests, so a very long
    conversation costs time in one task but no memory.  All rendering, parsing
    and escaping happens before, in parallel.
    """
    names = [c.split()[0] for c in READ_BACK.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, done = None, []
        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(c).to_pylist()
                                             for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if open_one is None or open_one.conv_id != conv:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Digest(conv)
                open_one.add(segment, a, b)
            yield batch_of(done)
            done = []
        yield batch_of([open_one.row()] if open_one is not None else [])

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
            .mapInArrow(run, READ_BACK))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and the control-string conversation -1, and read them back."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_turns(own.unionByName(extra)))
