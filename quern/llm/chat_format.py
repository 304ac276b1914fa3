"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " body "</turn>" newline

Roles of ROLES are written with a capital; any other is `@` and its percent-encoding. A control string is a whole header or
`</turn>`. In a body a run of k backslashes before a control string means k // 2 backslashes and, if k is odd, the control
string as text; if k is even the control string is live. Only `</turn>` may be live in a body, and ends it.

A turn is first written as it is. It is parsed again, and while the parser does not give back the very turn, its body is
escaped further: first the control strings inside, with the backslashes before them; then also backslashes at its end, which
would touch the end of the turn. That step always round-trips. Then the part of the conversation is parsed as a whole.

Output is a row for each part of a conversation: whole turns, PART characters or one turn, so that a conversation of any
length stays in bounded memory; parts in order are the conversation. `loss` has the spans of the assistant's bodies in
code points of the part. Rows meet by conversation in one shuffle, are sorted there by turn and pass as a stream. A
conversation is one sequence, with one running digest, so its rows pass one task one after another.

Null texts are empty; a null role is the empty role; rows of a null conv_id are one conversation. Rows of one turn follow by
role and text, null turns come first; repeated rows are turns of their own. Very long texts are written whole, into a part
of their own. An empty table has no conversations. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_NAMES = {v: k for k, v in ROLES.items()}
END = "</turn>"
#: The template's control strings, also for SQL.
CONTROL = r"### (?:User|Assistant|System|Tool|@[A-Za-z0-9_.~%-]*): |</turn>"
_HEADER = re.compile(r"### (User|Assistant|System|Tool|@[A-Za-z0-9_.~%-]*): ")
_CONTROL = re.compile(CONTROL)
_RUN = re.compile(rf"(\\*)({CONTROL})")
#: Characters after which a part ends.
PART = 1 << 20


class GrammarError(ValueError):
    pass


class Turn(NamedTuple):
    role: str
    text: str


def header(role: str) -> str:
    return f"### {ROLES.get(role) or '@' + quote(role, safe='')}: "


def escape(body: str, level: int) -> str:
    if level >= 1 and _CONTROL.search(body):
        body = _RUN.sub(lambda m: m[1] * 2 + "\\" + m[2], body)
    if level >= 2:
        bare = body.rstrip("\\")
        body = bare + "\\" * (2 * (len(body) - len(bare)))
    return body


def unescape(body: str) -> str:
    """What a body says, from the header to the live end of the turn; backslashes at its end touch that end."""
    bare = body.rstrip("\\")
    body = bare + "\\" * ((len(body) - len(bare)) // 2)
    return _RUN.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], body) if _CONTROL.search(body) else body


def parse(text: str) -> Iterator[tuple[Turn, int, int]]:
    """The turns of a rendered text and the spans of their bodies. One pass, no backtracking over turns."""
    at = 0
    while at < len(text):
        head = _HEADER.match(text, at)
        if not head:
            raise GrammarError(f"no header at {at}")
        for found in _CONTROL.finditer(text, head.end()):
            first = found.start()
            while first > head.end() and text[first - 1] == "\\":
                first -= 1
            if (found.start() - first) % 2 == 0:
                break
        else:
            raise GrammarError(f"the turn at {at} does not end")
        name, stop = head[1], found.start()
        if found[0] != END or not text.startswith("\n", found.end()):
            raise GrammarError(f"a live control string at {stop}")
        yield Turn(_NAMES.get(name) or unquote(name[1:]), unescape(text[head.end() : stop])), head.end(), stop
        at = found.end() + 1


def _same(text: str, turns: list[Turn]) -> bool:
    try:
        return [t for t, _, _ in parse(text)] == turns
    except GrammarError:
        return False


def render(turn: Turn) -> tuple[str, int]:
    """A turn's text, escaped as far as its round trip needs, and the level that took."""
    for level in range(3):
        text = f"{header(turn.role)}{escape(turn.text, level)}{END}\n"
        if _same(text, [turn]):
            return text, level
    raise GrammarError("a turn that cannot be escaped")


def format_conversations(rows: DataFrame, part_chars: int = PART) -> DataFrame:
    """conv_id, part (from 0), last, n_turns, text, loss (spans within the part) for rows (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def closed(conv: object, part: int, last: bool, turns: list[Turn], texts: list[str]) -> tuple:
        text = "".join(texts)
        parsed = list(parse(text))
        if [t for t, _, _ in parsed] != turns:
            raise GrammarError(f"part {part} of conversation {conv} does not parse to its source")
        return conv, part, last, len(turns), text, [{"start": a, "end": b} for t, a, b in parsed if t.role == "assistant"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, turns, texts, chars = None, 0, [], [], 0
        done: list[tuple] = []
        kinds: list[pa.DataType] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "last", "n_turns", "text", "loss"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.int64(), pa.string(), span]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if turns and (conv != now or chars >= part_chars):
                    done.append(closed(now, part, conv != now, turns, texts))
                    part, turns, texts, chars = part + 1, [], [], 0
                    if sum(len(d[4]) for d in done) >= part_chars or len(done) >= 200:
                        yield batch_of()
                if conv != now:
                    now, part = conv, 0
                turns.append(Turn(role.as_py() or "", text.as_py() or ""))
                texts.append(render(turns[-1])[0])
                chars += len(texts[-1])
        if turns:
            done.append(closed(now, part, True, turns, texts))
            yield batch_of()

    own = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sorted_ = small_batches(own).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return sorted_.mapInArrow(run, f"conv_id {kind}, part long, last boolean, n_turns long, text string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations as their formatted text and loss spans say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            for conv, part, last, text, loss in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if part == 0:
                    n, chars, loss_chars, all_, lost = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for turn, _, _ in parse(text):
                    n += 1
                    all_.update(f"{turn.role}\n{turn.text}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(said)
                    lost.update(said.encode())
                chars += len(text)
                if last:
                    done.append((conv, n, all_.hexdigest(), loss_chars, lost.hexdigest(), chars))
            if done:
                columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    # Most conversations are one part and are read where they lie; the parts of the others meet in order.
    whole = formatted.filter("part = 0 and last")
    split = formatted.filter("not (part = 0 and last)").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return whole.select("conv_id", "part", "last", "text", "loss").mapInArrow(run, schema).unionByName(split.select("conv_id", "part", "last", "text", "loss").mapInArrow(run, schema))
