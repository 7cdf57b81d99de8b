"""Operator 8 against a plain count-based model, and the Elias-Fano parts against arrays."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import ngram_lm
from lectern.llm.eliasfano import EliasFano, Trie, pack_bits, quantise, read_bits
from lectern.llm.queries import op8_ngram_lm
from lectern.session import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(docs, order=3, least=1):
    """Scores by counts in dictionaries, and a function of a context and a word for the model's probability."""
    train = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in docs}
    c, grams, context, followers = Counter(), Counter(), Counter(), {}
    for d, t in docs:
        if train[d]:
            w = ["<s>", *tokens(t)]
            c.update(w[1:])
            for n in range(2, order + 1):
                grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for g, x in grams.items():
        context[g[:-1]] += x
        if x >= least:
            followers[g[:-1]] = followers.get(g[:-1], 0) + x - 0.75
    n, v = sum(c.values()), len(c)

    def p(before, x):
        if not before:
            return ((max(c[x] - 0.7, 0) / n if c[x] else 0) + 0.7 * v / n / (v + 1)) if n else 1.0
        lower, total = p(before[1:], x), context[before]
        if not total:
            return lower
        own = grams[(*before, x)]
        return (own - 0.75 if own >= least else 0) / total + (1 - followers.get(before, 0) / total) * lower

    out = {}
    for d, t in docs:
        w = ["<s>", *tokens(t)]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        out[d] = (not train[d], len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, base, score)
    return out, p, c


def check(spark, docs, rough=1e-4, **kw):
    rows = ngram_lm.score_documents(docs, ~ngram_lm.held_out(docs["doc_id"]), **kw).collect()
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], **kw)[0]
    assert len(rows) == len(expected)
    for r in rows:
        e = expected[r.doc_id]
        assert (not r.train, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert r.base_score == pytest.approx(e[4], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(e[5], rel=rough, abs=1e-4)


def test_probabilities_sum_to_one():
    _, p, c = brute([(i, t) for i, t in enumerate(["a b a c", "a b b", "b a b a", "c"] * 3)])
    for before in [(), ("a",), ("a", "b"), ("<s>", "a"), ("q", "r")]:
        assert sum(p(before, x) for x in [*c, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 4])
def test_orders_and_pruning(spark, order):
    import random

    from lectern.llm.storage import stored

    rng = random.Random(order)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefg", weights=(9, 7, 5, 3, 2, 1, 1), k=rng.randint(0, 40)))) for i in range(60)], "doc_id long, text string")
    check(spark, stored(docs.repartition(3), "t"), order=order, least=1 + order // 4, rough=1e-2)


def test_many_shards_and_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 4000)
    check(spark, table(spark, sf_dir, "documents"), rough=2e-3)


def test_whole_table(spark, sf_dir):
    check(spark, table(spark, sf_dir, "documents"), rough=2e-3)
    rows = op8_ngram_lm(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark, edge_docs, empty_docs):
    from lectern.llm.storage import stored

    check(spark, stored(edge_docs.dropDuplicates(["doc_id"]), "t"))
    assert ngram_lm.score_documents(empty_docs, ~ngram_lm.held_out(empty_docs["doc_id"])).count() == 0
    one = stored(edge_docs.filter("doc_id = 6"), "t")
    assert ngram_lm.score_documents(one, one["doc_id"] < 0).collect()[0].n_known == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=200), st.integers(1, 64))
def test_elias_fano(values, width):
    values = np.array(sorted(values), np.uint64)
    fano = EliasFano.of(values)
    assert fano.access(np.arange(len(values))).tolist() == values.tolist()
    wanted = np.concatenate([values, values + np.uint64(1), np.array([0, 2**62 + 5], np.uint64)])
    assert fano.successor(wanted).tolist() == np.searchsorted(values, wanted).tolist()
    small = values & np.uint64((1 << width) - 1)
    assert read_bits(pack_bits(small, width), np.arange(len(small)), width).tolist() == small.tolist()


def test_trie_on_disk(tmp_path):
    rng = np.random.default_rng(2)
    grams = sorted({(int(a) * 7, int(b), int(c)) for a, b, c in zip(rng.integers(0, 9, 900), rng.integers(0, 2**40, 40).repeat(23)[:900], rng.integers(0, 30, 900), strict=True)})
    roots, pairs = sorted({g[0] for g in grams}), sorted({g[:2] for g in grams})
    value2, value3 = rng.integers(1, 50, len(pairs)) - 0.75, 2.0 ** -rng.integers(4, 20, len(grams))
    levels = [
        (np.array([roots.index(a) for a, _ in pairs]), np.array([b for _, b in pairs], np.uint64), value2),
        (np.array([pairs.index(g[:2]) for g in grams]), np.array([g[2] for g in grams], np.uint64), value3),
    ]
    path = tmp_path / "trie"
    path.write_bytes(Trie.of(np.array(roots, np.uint64), levels, [40, 32]).to_bytes())
    trie = Trie.view(np.memmap(path, np.uint8, "r"))
    asked = [*grams, *((a + d, b + e, c + 1) for a, b, c in grams for d in (0, 1) for e in (0, 1))]
    first, second, third = (np.array(x, np.uint64) for x in zip(*asked, strict=True))
    one = trie.root(first)
    two = trie.child(0, one, second)
    three = trie.child(1, two, third)
    assert one.tolist() == [roots.index(a) if a in roots else -1 for a, _, _ in asked]
    assert two.tolist() == [pairs.index(g[:2]) if g[:2] in pairs else -1 for g in asked]
    assert three.tolist() == [grams.index(g) if g in grams else -1 for g in asked]
    _, _, codes, book, backoff = trie.levels[0]
    assert book[codes].tolist() == value2.tolist()
    assert backoff.tolist() == pytest.approx([1 - sum(v for g, v in zip(grams, value3, strict=True) if g[:2] == p) for p in pairs])


def test_quantise():
    few, codes = quantise(np.array([1.25, 2.25, 1.25]))
    assert few[codes].tolist() == [1.25, 2.25, 1.25]
    many = np.arange(2, 5000) - 0.75
    book, codes = quantise(many)
    assert len(book) <= 256
    assert (book[codes] <= many).all() and (book[codes] > 0.95 * many).all()


def test_other_documents_are_an_error(tmp_path):
    import pyarrow as pa

    with pa.ipc.new_stream(str(tmp_path / "7.answers"), ngram_lm._ANSWER) as stream:
        stream.write_table(pa.Table.from_pylist([{"kind": 1, "shard": 0, "block": 7, "check": 5, "parts": []}], ngram_lm._ANSWER))
    assert ngram_lm._answers(f"file://{tmp_path}", 7, 5) == {(1, 0): []}
    for block, check_ in ((7, 6), (8, 5)):
        with pytest.raises(RuntimeError):
            ngram_lm._answers(f"file://{tmp_path}", block, check_)


def test_blocks_do_not_depend_on_batches(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 50)
    rng = random.Random(6)
    docs = pa.table({"doc_id": list(range(80)), "text": ["x" * rng.choice([0, 3, 20, 49, 50, 51, 200]) for _ in range(80)], "train": [True] * 80})
    found = [[tuple(t.column("doc_id").to_pylist()) for t in ngram_lm._runs_of_documents(docs.to_batches(n))] for n in (1, 3, 7, 80)]
    assert found[0] == found[1] == found[2] == found[3] and sum(found[0], ()) == tuple(range(80))
    assert all(len(b) == 1 or sum(len(docs["text"][i].as_py()) for i in b) <= 50 for b in found[0])
