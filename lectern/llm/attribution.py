"""Operator 6. Token counts of fields and sections by offset-mapped attribution.

A text is encoded whole, once. Each token covers a span of the text; spans follow from the ids, as the vocabulary
lists the bytes of each. An interval join by binary search gives each token to the section that holds its first
character (``rule="first"``) or its last one (``rule="last"``): a token that crosses a border counts once, on one
side. Tokens outside every section are counted under section -1.

Edge cases: null or empty text: no tokens, and no row unless sections are given. Sections of no length get none.
Repeated rows are counted each. Very long texts are encoded whole, in the memory of one task. Columns other than doc_id,
text and that of the sections are not read. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.pieces import encoder, forget, text_runs
from lectern.llm.workers import tidy

_lengths: dict[str | None, np.ndarray] = {}


def token_bytes(vocabulary: str | None = None) -> np.ndarray:
    """The number of bytes of each id: a byte-level vocabulary spells a byte as one character."""
    if vocabulary not in _lengths:
        vocab = encoder(vocabulary).library.get_vocab()
        table = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            table[i] = len(token)
        _lengths[vocabulary] = table
    return _lengths[vocabulary]


def attribute(ids: np.ndarray, text: bytes, sections: list[tuple[int, int]], lengths: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section, and last those of none. Sections are spans of characters, in order, apart."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size if rule == "first" else ends - 1
    raw = np.frombuffer(text, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)[at] - 1 if len(at) else np.zeros(0, np.int64)
    if not sections:
        return np.array([len(ids)])
    starts, stops = np.array(sections).T
    held = np.searchsorted(starts, char, side="right") - 1
    inside = (held >= 0) & (char < stops[np.maximum(held, 0)])
    return np.bincount(np.where(inside, held, len(sections)), minlength=len(sections) + 1)


def lines(text: str) -> list[tuple[int, int]]:
    """Each line with its newline is a section; together they are the text."""
    out, at = [], 0
    for part in text.split("\n"):
        end = min(len(text), at + len(part) + 1)
        if end > at:
            out.append((at, end))
        at = end
    return out


def section_tokens(docs: DataFrame, rule: str = "first", sections: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, first_char, end_char, n_tokens.

    ``sections`` names a column ``array<struct<start, end>>`` of character spans; by default lines are sections.
    """

    def count(batches):
        table = token_bytes(vocabulary)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i in range(0, len(docs), 256):
                texts = batch.column(1).slice(i, 256).to_pylist()
                spans = batch.column(2).slice(i, 256).to_pylist() if sections else None
                for span in text_runs(texts):
                    out: list[list] = [[] for _ in range(5)]
                    for j, raw in enumerate(encoder(vocabulary).encode(texts[span]), i + span.start):
                        text = texts[j - i]
                        parts = [(s["start"], s["end"]) for s in spans[j - i] or []] if sections else lines(text)
                        parts = sorted(p for p in parts if p[1] > p[0])
                        n = attribute(np.frombuffer(raw, "<u4"), text.encode(), parts, table, rule)
                        for k, (a, b) in enumerate(parts):
                            for column, value in zip(out, (docs[j], k, a, b, int(n[k])), strict=True):
                                column.append(value)
                        if n[-1]:
                            for column, value in zip(out, (docs[j], -1, None, None, int(n[-1])), strict=True):
                                column.append(value)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "section", "first_char", "end_char", "n_tokens"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    if sections:
        columns.append(F.expr(f"transform({sections}, s -> named_struct('start', cast(s.start as long), 'end', cast(s.end as long)))").alias("sections"))
    return docs.select(*columns).mapInArrow(tidy(count, forget), "doc_id long, section int, first_char long, end_char long, n_tokens long")
