"""Token ids of whole texts by the tokenizers library, with a memo of pieces.

A byte-level vocabulary never joins what a blank parts: wherever white space follows other text, a token ends. So
a text is cut there, each distinct piece is encoded once by the library, and the ids of a text are those of its
pieces in a row. Results equal those of encoding the whole text (tests compare them).

Strings of the vocabulary's special tokens that occur in a text are those tokens, as the library has it by default,
and text is cut around them first; with ``special=False`` they are ordinary text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Texts that are encoded at once, if they are not long: the more, the fewer distinct pieces there are for each.
TEXTS = 1024
#: White space other than blank and newline, by any of Unicode's and Python's definitions, and the mark used here.
_ODD = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r"(?<=\S)(?=\s)")
_SLOW = ("  ", "\n\n", " \n", "\n ", *_ODD)
#: Byte-level vocabularies spell printable bytes as themselves, others by code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
_HAS_ODD = re.compile(f"[{_ODD}]").search


def cut_pieces(text: str) -> list[str]:
    """The text in pieces that share no token; joined they are the text."""
    for p in _SLOW:
        if p in text:
            return _CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes. The memo has two generations of ``limit / 2`` pieces at a batch's start: when
    the younger is full it becomes the older, from which pieces that are met again come back."""

    def __init__(self, path: str | None = None, limit: int = 400_000, special: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        names = sorted((t.content for t in self.library.get_added_tokens_decoder().values() if t.special), key=len, reverse=True) if special else []
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.slow = (*_SLOW, *names)
        self.limit, self.memo, self.old = limit, {}, {}
        newline = self.library.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.packed = [struct.pack("<I", i) for i in range(max(self.library.get_vocab().values()) + 1)]
        self.marks = {p: np.array(self.library.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in ".,"}

    def _learn(self, new: set[str]) -> None:
        memo = self.memo
        # A letter and a full stop or comma at the end never share a token, so words are learned without the latter.
        marked = [p for p in new if p[-1:] in (".", ",") and p[-2:-1].isalpha()] if self.marks else []
        if marked:
            new.difference_update(marked)
            new.update({p[:-1] for p in marked}.difference(memo))
        # Letters, with a blank before them or not, are one word to the library: its model takes them as they are.
        tokenize, packed = self.library.model.tokenize, self.packed
        words = [p for p in new if (p[1:] if p[:1] == " " else p).isalpha()] if self.marks else []
        for p in words:
            spelled = p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS)
            memo[p] = b"".join([packed[t.id] for t in tokenize("\u0120" + spelled[1:] if p[0] == " " else spelled)])
        new.difference_update(words)
        # Pieces without a newline are encoded in one call, parted by newlines, whose id no other token holds.
        plain = [p for p in new if p and p.find("\n") < 0 and p.find(" ", 1) < 0 and p != " " and not _HAS_ODD(p)]
        if self.newline is None:
            plain = []
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.array(self.library.encode_batch_fast(["\n".join(part) + "\n"], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.newline)
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins newlines with other text")
            raw, s = ids.tobytes(), 0
            for p, e in zip(part, (4 * ends).tolist(), strict=True):
                memo[p] = raw[s:e]
                s = e + 4
        rest = list(new.difference(plain))
        for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            memo[p] = np.array(e.ids, dtype="<u4").tobytes()
        for p in marked:
            memo[p] = memo[p[:-1]] + self.marks[p[-1]]

    def cut(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return cut_pieces(text)
        return [p for k, part in enumerate(parts) if part for p in ([part] if k % 2 else cut_pieces(part))]

    def _know(self, pieces: set[str]) -> None:
        """All of the pieces are in the memo until the next call."""
        if len(self.memo) > self.limit // 2:
            self.memo, self.old = {}, self.memo
        new = pieces.difference(self.memo)
        again = new.intersection(self.old)
        self.memo.update((p, self.old[p]) for p in again)
        new.difference_update(again)
        if new:
            self._learn(new)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        out = [b""] * len(texts)
        slow = [k for k, t in enumerate(texts) if any(p in t for p in self.slow)]
        if slow:
            cut = [self.cut(texts[k]) for k in slow]
            self._know(set().union(*cut))
            memo = self.memo
            for k, p in zip(slow, cut, strict=True):
                out[k] = b"".join(itemgetter(*p)(memo)) if len(p) > 1 else memo[p[0]]
        rest = sorted(set(range(len(texts))).difference(slow)) if slow else range(len(texts))
        for k, raw in zip(rest, self._encode_plain([texts[k] for k in rest]), strict=True):
            out[k] = raw
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts whose white space is single blanks and newlines, cut as by ``cut_pieces``, and before a full stop or comma at a
        piece's end that an ASCII letter precedes. Pieces are numbered by Arrow, and only distinct ones become strings."""
        raw = [t.encode() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64))).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return raw
        newline = data == 10
        first = (data == 32) | newline
        first[1:] |= newline[:-1]
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        if self.marks:
            letter = (data | 32) - 97 < 26
            mark = (data == 46) | (data == 44)
            mark[1:] &= letter[:-1]
            mark[:-1] &= first[1:]
            first |= mark
        offsets = np.append(np.flatnonzero(first), len(data))
        coded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._know(set(names))
        ids = pa.array(itemgetter(*names, names[0])(self.memo)[:-1], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(offsets, bounds)].tolist()
        joined = memoryview(ids.buffers()[2])
        return [bytes(joined[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[tuple[str | None, bool], PieceEncoder] = {}


def encoder(path: str | None = None, special: bool = True) -> PieceEncoder:
    """One for each worker process and vocabulary file, as opening it takes a while."""
    if (path, special) not in _encoders:
        _encoders[path, special] = PieceEncoder(path, special=special)
    return _encoders[path, special]


def forget() -> None:
    """Empty the memos of this process, for the end of a task."""
    for x in _encoders.values():
        x.memo, x.old = {}, {}


def text_runs(texts: list, most: int = 1 << 21) -> Iterator[slice]:
    """Spans of texts of at most so many characters, or one text."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if j > i and n + len(t) > most:
            yield slice(i, j)
            i, n = j, 0
        n += len(t)
    if i < len(texts):
        yield slice(i, len(texts))
