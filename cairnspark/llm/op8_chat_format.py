"""Chat formatting with typed content parts.

Each turn's content is a list of parts (text, image, audio, document). A visitor flattens them
in order: text is escaped, other parts become numbered placeholders whose attachment reference
and expanded token count are recorded. One row per turn is formatted on its own, so no
conversation is gathered for it; a conversation's text is its turns' pieces in order.

Escaping: a backslash is doubled, and each of the characters < | [ that control strings begin or go on with is
followed by one backslash. So after any of the three comes a backslash, and no control string (<|, |>, <s>, </s>, [INST],
<<SYS>> and their like) is left in a role or a text. The way back: of each run of backslashes half stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import staged

_opens, _escape = re.compile(r"([<|\[])"), re.compile(r"\\(\\?)")
OPEN, CLOSE, END = "<|turn ", "|>\n", "\n<|end|>\n"
#: Tokens that a part takes in place of its placeholder, unless it names its own count; a part of a type not named here: 0.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return _opens.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escape.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn."""

    def __init__(self):
        self.out: list[str] = []
        self.texts: list[int] = []  # places in out that are text
        self.refs: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(len(self.out))
        self.out.append(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = part["type"]
        self.attach(part, kind, EXPANDED[kind])

    visit_image = visit_audio = visit_document = visit_attachment

    def visit_unknown(self, part: dict) -> None:
        """A type that isn't known is kept as a reference under its own name, behind a placeholder of no type."""
        self.attach(part, "part", 0)

    def attach(self, part: dict, mark: str, expanded: int) -> None:
        n = part.get("n_tokens")
        self.refs.append({"place": len(self.refs), "type": part["type"], "ref": part.get("ref"), "n_tokens": expanded if n is None else int(n)})
        self.out.append(f"<|{mark}:{len(self.refs) - 1}|>")


def format_turn(role: str | None, parts: list[dict] | None, loss_role: str) -> tuple[str, list[dict], list[dict]]:
    """The piece; the bounds in it of the texts under the loss mask (placeholders are not); and the attachments."""
    v = Flatten()
    for p in parts or []:
        v.visit(p)
    at, bounds = len(OPEN) + len(escape(role or "")) + len(CLOSE), []
    for k, x in enumerate(v.out):
        if role == loss_role and k in v.texts:
            bounds.append({"lo": at, "hi": at + len(x)})
        at += len(x)
    return OPEN + escape(role or "") + CLOSE + "".join(v.out) + END, bounds, v.refs


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and body text of a piece without attachments: the way back."""
    head = piece.index(CLOSE)
    return unescape(piece[len(OPEN) : head]), unescape(piece[head + len(CLOSE) : -len(END)])


_REFS = pa.list_(pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))
_LOSS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def format_turns(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """rows: conv_id, turn, role, content array<struct<type, text, ref, n_tokens>>; out: a formatted row per turn.

    Narrow. A null role or text counts as empty, a null or empty content as no parts, a part without type as text; a part of
    another type is kept as an attachment of that type with no tokens of its own. Repeated rows are each formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [format_turn(r, c, loss_role) for r, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), _LOSS, _REFS))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), *columns], names=["conv_id", "turn", "piece", "loss", "attachments"])

    schema = "conv_id long, turn long, piece string, loss array<struct<lo:long,hi:long>>, attachments array<struct<place:int,type:string,ref:string,n_tokens:long>>"
    return rows.select("conv_id", "turn", "role", "content").mapInArrow(run, schema)


def text_parts(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) with each text as its one part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("content"))


class _Digest:
    """Running hashes of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.formatted = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, bounds: list[dict]) -> None:
        role, body = parse_turn(piece)
        self.turns += 1
        self.all.update(f"{role}\n{body}\n".encode())
        for x in bounds:
            text = unescape(piece[x["lo"] : x["hi"]])
            self.chars += len(text)
            self.loss.update(text.encode())
        self.formatted += len(piece)

    def row(self) -> list:
        return [self.conv, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted]


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted pieces in order of turn (null first), then piece.

    A conversation's rows are sorted, not gathered: a task streams over them and holds one
    batch and running hashes, however long a conversation is. The formatting itself has been done
    row by row before. A null conv_id is a conversation of its own; repeated rows are turns of their own; rows of a table
    that has a conversation -1 itself join that one; an empty table has no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        now = None
        for b in batches:
            out = []
            for conv, piece, bounds in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                now.add(piece, bounds)
            if out:
                yield batch(out)
        if now is not None:
            yield batch([now.row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = formatted.select("conv_id", "piece", "loss", "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").mapInArrow(run, schema)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Formats the rows (conv_id, turn, role, text) into a table and reads its digest back."""
    return digest(staged(format_turns(text_parts(conversations)), "chat"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT conv_id, turn, role, text, '<|turn ' || regexp_replace(replace(role, '\', '\\'), '([<|\[])', '\1\\', 'g') || '|>' || chr(10)
  || regexp_replace(replace(text, '\', '\\'), '([<|\[])', '\1\\', 'g') || chr(10) || '<|end|>' || chr(10) AS piece FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
