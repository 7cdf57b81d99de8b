"""Operator 10. Chat formatting by assembly of tokens.

A conversation becomes ``### role: text</turn>`` and a newline for each turn. Roles and texts are encoded apart from
each other, and the three control strings are reserved ids above the vocabulary, spliced between them, so no token
crosses from a control string into a text. Segment lengths summed up give the places of all segments, and the loss
mask is the running sum of +1 where a trained segment starts and -1 where it ends: it covers the assistant's texts only.

Texts may hold control strings: backslashes, ``###`` and ``</turn>`` get a backslash in front (in roles ``:`` too), so
that formatted text can be parsed and texts come back as they were.

Edge cases: null text and null role are empty. Turns are ordered by turn, role and text; repeated rows stay. Null
conv_id is a conversation of its own. Very long texts are encoded whole; a task holds one conversation at a time, as its
turns make one sequence of tokens. Columns other than conv_id, turn, role and text are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.pieces import PRINTABLE, encoder

START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Assembler:
    """Builds and reads token sequences; reserved ids start where the vocabulary ends."""

    def __init__(self, vocabulary: str | None = None):
        self.encoder = encoder(vocabulary, special=False)
        vocab = self.encoder.library.get_vocab()
        self.start = max(vocab.values()) + 1
        self.role_end, self.turn_end = self.start + 1, self.start + 2
        letters = self._byte_letters()
        self.bytes = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in vocab.items()}
        self.bytes |= {self.start: START.encode(), self.role_end: ROLE_END.encode(), self.turn_end: TURN_END.encode()}

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The byte that each character of a token's spelling stands for."""
        other = [b for b in range(256) if b not in PRINTABLE]
        return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(other)}

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of (role, text) turns."""
        texts = [t for role, text in turns for t in (escape(role, True), escape(text))]
        parts, trained = [], []
        for i, raw in enumerate(self.encoder.encode(texts)):
            ids = np.frombuffer(raw, "<u4")
            if i % 2:
                parts += [ids, np.array([self.turn_end], "<u4")]
                trained += [turns[i // 2][0] == TRAINED, False]
            else:
                parts += [np.array([self.start], "<u4"), ids, np.array([self.role_end], "<u4")]
                trained += [False, False, False]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
        for k in np.flatnonzero(trained):
            change[ends[k] - len(parts[k])] += 1
            change[ends[k]] -= 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.cumsum(change[:-1]).astype(np.int8)

    def text(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()

    def read(self, ids: list[int], mask: list[int]) -> tuple[list[tuple[str, str]], str]:
        """The turns and the text under the mask, from ids alone."""
        turns, role, held, covered, masked = [], "", [], [], []
        for i, m in zip(ids, mask, strict=True):
            if i == self.start:
                held = []
            elif i == self.role_end:
                role, held = unescape(self.text(held)), []
            elif i == self.turn_end:
                turns.append((role, unescape(self.text(held))))
                covered.append(unescape(self.text(masked)))
                held, masked = [], []
            else:
                held.append(i)
                if m:
                    masked.append(i)
        return turns, "".join(covered)


_assemblers: dict[str | None, Assembler] = {}


def assembler(vocabulary: str | None = None) -> Assembler:
    if vocabulary not in _assemblers:
        _assemblers[vocabulary] = Assembler(vocabulary)
    return _assemblers[vocabulary]


def format_conversations(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, ids, loss_mask (0 or 1 for each id)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def build(batches):
        for batch in batches:
            ids_of, turns = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 64):
                ids, masks = [], []
                for row in turns.slice(i, 64).to_pylist():
                    a, b = assembler(vocabulary).assemble([(t["role"], t["text"]) for t in row])
                    ids.append(a.astype(np.int32))
                    masks.append(b)
                yield pa.RecordBatch.from_arrays([ids_of.slice(i, 64), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], ["conv_id", "ids", "loss_mask"])

    return grouped.mapInArrow(build, "conv_id long, ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of the turns, the trained text and the formatted text, from ids and masks."""

    def read(batches):
        tool = assembler(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out: list[list] = [[] for _ in range(5)]
                for ids, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    turns, trained = tool.read(ids, mask)
                    said = "".join(f"{role}\n{text}\n" for role, text in turns)
                    for column, value in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(tool.text(ids))), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same digests from the table itself, in DuckDB's SQL.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS shown,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS shown_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(shown_role) + 2 + length(shown) + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
