"""Operators 5, 6 and 7 against the tokenizers library itself."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import attribution, bitplanes, packing
from lectern.llm.pieces import PieceEncoder, encoder
from lectern.llm.queries import op5_best_fit_packing, op7_bit_plane_output
from lectern.llm.storage import shared_folder, stored
from lectern.session import table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85  　'sabAB1!.é漢\0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_whole_texts(text):
    assert np.frombuffer(encoder().encode([text])[0], "<u4").tolist() == ids_of(text)


def learned(monkeypatch):
    """Pieces that encoders give to the library from now on, in order."""
    learn, found = PieceEncoder._learn, []

    def count(self, new):
        found.extend(new)
        learn(self, new)

    monkeypatch.setattr(PieceEncoder, "_learn", count)
    return found


def test_a_full_memo_keeps_what_is_met_again(monkeypatch):
    found, coder = learned(monkeypatch), PieceEncoder(limit=100)
    common = " uncommonly internationalised"
    for k in range(30):
        text = "".join(f" longish{k}x{j}" for j in range(40)) + common
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == ids_of(text)
    assert found.count(" internationalised") == 1
    assert len(coder.memo) + len(coder.old) <= 200


def test_marks_after_words_are_pieces(monkeypatch):
    found, coder = learned(monkeypatch), PieceEncoder()
    texts = ["one word, a word. Word", "", "word,\nword. a.b, 1. é. x", ".", "end of,", ",", "a", ". word"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [ids_of(t) for t in texts]
    assert {" word,", " word.", "word,"}.isdisjoint(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "word", ".", "\0"]), max_size=12))
def test_special_tokens_in_texts(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder().encode([text])[0], "<u4").tolist() == ids_of(text)
    assert 50256 not in np.frombuffer(encoder(special=False).encode([text])[0], "<u4")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    ids = np.array(ids, "<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(ids, bits), len(ids), bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    class Sink(io.BytesIO):
        def close(self):
            pass

    docs = [(7 * i, np.random.default_rng(i).integers(0, 50257, i * 13 % 97).astype("<u4")) for i in range(60)]
    sink = Sink()
    writer = bitplanes.PlaneWriter(sink, bits, block=64)
    for doc, ids in docs:
        writer.add(doc, ids.tobytes())
    writer.close()
    reader = bitplanes.PlaneReader(sink)
    assert [(d, b"".join(p)) for d, _, p in reader.documents()] == [(d, i.tobytes()) for d, i in docs]
    everything = np.concatenate([i for _, i in docs])
    assert reader.ids(50, 200).tolist() == everything[50:250].tolist()


def check_output(rows, docs):
    at = 0
    expected = []
    for doc, text in sorted(docs, key=lambda r: (r[0], r[1] or "")):
        ids = [*ids_of(text), 0]
        expected.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_op7(spark, edge_docs, empty_docs, sf_dir):
    for docs in (edge_docs, table(spark, sf_dir, "documents")):
        manifest = stored(bitplanes.write_ids(docs, shared_folder(spark, "t")), "m")
        check_output(bitplanes.read_ids(manifest).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    manifest = stored(bitplanes.write_ids(empty_docs, shared_folder(spark, "t")), "m")
    assert bitplanes.read_ids(manifest).count() == 0
    assert op7_bit_plane_output(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(len(x) for x in by_doc.values()) == len(rows)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in docs:
        ids = [*ids_of(text), 0]
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
            assert k == 0 or r.length == capacity
        assert at == len(ids)
        assert len(parts) == 1 or len(ids) > capacity
    return len(by_sequence)


def test_op5(spark, sf_dir, edge_docs, empty_docs):
    docs = table(spark, sf_dir, "documents")
    rows = op5_best_fit_packing(spark, sf_dir).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 2
    single = edge_docs.dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(single, 16).collect(), [(r.doc_id, r.text) for r in single.collect()], 16)
    assert packing.pack_documents(empty_docs).count() == 0
    assert packing.pack_documents(edge_docs).count() == edge_docs.count() + 1  # one text needs two sequences


def test_rounds_pack_what_was_left_open(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 10)
    docs = table(spark, sf_dir, "documents")
    rows = packing.pack_documents(docs, 512, 8).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 512)
    assert used <= 1.15 * sum(r.length for r in rows) / 512


def test_sequences_hold_the_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = stored(packing.piece_rows(docs, 256, with_ids=True), "p")
    packed = packing.pack_pieces(pieces.drop("ids"), 256)
    texts = {r.doc_id: [*ids_of(r.text), 0] for r in docs.collect()}
    starts = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for row in packing.sequences(packed, pieces).collect():
        for b in row.bounds:
            r = starts[row.sequence_id, b.offset]
            assert row.ids[b.offset : b.offset + b.length] == texts[r.doc_id][r.start : r.start + r.length]


def test_best_fit_is_bounded_and_closes_the_fullest():
    rng = random.Random(1)
    fit, bins, kept = packing.BestFit(100, 4), [], []
    for i in range(500):
        n = rng.randint(1, 100)
        free = sorted(f for f in fit.at for _ in fit.at[f])
        best = next((f for f in free if f >= n), None)
        closed = fit.add((i, n), n)
        assert fit.count <= 4
        if best is None and len(free) == 4:
            assert 100 - sum(x[1] for x in closed[0]) == free[0]
        bins += closed
    bins += fit.close()
    for items in bins:
        assert sum(n for _, n in items) <= 100
        kept += [i for i, _ in items]
    assert sorted(kept) == list(range(500))


def test_op6_counts_by_the_first_character(spark, sf_dir, edge_docs):
    for docs in (table(spark, sf_dir, "documents").limit(40), edge_docs.dropDuplicates(["doc_id"])):
        found = {(r.doc_id, r.section): r for r in attribution.section_tokens(docs).collect()}
        for row in docs.collect():
            text = row.text or ""
            spans = attribution.lines(text)
            assert "".join(text[a:b] for a, b in spans) == text
            expected = dict.fromkeys(range(len(spans)), 0)
            for a, _ in LIBRARY.encode(text, add_special_tokens=False).offsets:
                expected[next(i for i, s in enumerate(spans) if s[0] <= a < s[1])] += 1
            assert {k[1]: r.n_tokens for k, r in found.items() if k[0] == row.doc_id} == expected


def test_op6_named_sections_and_rules(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5), (8, 12)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    n = {rule: {r.section: r.n_tokens for r in attribution.section_tokens(docs, rule, "parts").collect()} for rule in ("first", "last")}
    tokens = LIBRARY.encode("alpha beta gamma", add_special_tokens=False).offsets
    for rule, pick in (("first", 0), ("last", 1)):
        place = [a if pick == 0 else b - 1 for a, b in tokens]
        place = [min(p, 15) for p in place]
        assert n[rule].get(0, 0) + n[rule].get(1, 0) + n[rule].get(-1, 0) == len(tokens)
        assert n[rule][0] == sum(p < 5 for p in place)
