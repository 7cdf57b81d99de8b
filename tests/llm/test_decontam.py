"""Operator 3 against a brute-force search of windows."""

from __future__ import annotations

import hashlib
import re

import pytest

from lectern.llm import decontam
from lectern.session import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    found |= windows[key]
                    hit.update(range(i, i + n))
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def check(docs, benchmark, **kw):
    found = decontam.report(docs, benchmark, **kw)
    rows = [tuple(r)[:6] for r in found.collect()]
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()], **kw)
    assert sorted(rows) == expected
    return expected


def test_whole_tables(spark, sf_dir):
    assert any(r[5] for r in check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@pytest.fixture
def items(spark):
    rows = [(3, "The cat sat"), (12, "a b c d e f g h i j k l"), (2, "a a a a a a a a a a a a a"), (4, None), (5, "..."), (12, "Ünï çødé"), (7, "cat")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edges(spark, edge_docs, items, empty_docs):
    more = spark.createDataFrame([(100, "x a b c d e f g h i j z"), (101, "a " * 40), (102, "ünï, çødé"), (103, "b c d e f g h i j k"), (104, "a b c d e f g h i")], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(more)
    check(docs, items)
    check(docs, items, window=3)
    check(docs, items.limit(0))
    assert decontam.report(empty_docs, items).count() == 0


def test_blocks_of_items_agree_with_one_block(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = decontam.find_matches(docs, benchmark).orderBy("doc_id").collect()
    many = decontam.find_matches(docs, benchmark, block_bytes=3000).orderBy("doc_id").collect()
    assert [(r.doc_id, r.hit_spans, r.hit_items) for r in one] == [(r.doc_id, r.hit_spans, r.hit_items) for r in many]


def longest(doc, items, window=10):
    """Words, first word and item of the longest common runs that hold a window, by trying all pairs of places."""
    w, best = words(doc), (0, None, None)
    for item, text in items:
        t = words(text)
        for i in range(len(w)):
            for j in range(len(t)):
                n = 0
                while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                    n += 1
                if n >= min(window, len(t)) and (n > best[0] or n == best[0] and i < best[1]):
                    best = (n, i, item)
    return best[:2]


def test_longest_match_and_removal(spark, items):
    docs = spark.createDataFrame([(1, "q a b c d e f g h i j k z", 5), (2, "nothing here", 6)], "doc_id long, text string, n_words int")
    found = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in decontam.find_matches(docs, items).collect()}
    assert found == {1: (11, 1, 12), 2: (0, None, None)}
    assert decontam.decontaminate(docs, items).collect() == [(2, "nothing here", 6)]


def test_longest_matches_agree_with_brute_force():
    import random

    import pyarrow as pa

    from lectern.llm.wordarrays import buffers

    rng = random.Random(4)
    for round_ in range(40):
        items = [(i % 5, " ".join(rng.choices("abc", k=rng.randint(0, 14)))) for i in range(8)]
        docs = [" ".join(rng.choices("abcd", weights=(9, 9, 9, 1), k=rng.randint(0, 60))) for _ in range(6)]
        docs.append(items[0][1] + " " + items[1][1])
        found = decontam.search(decontam.prepare(items, 4), *buffers(pa.array(docs)))[3]
        expected = [(i, *m) for i, m in enumerate(longest(d, items, 4) for d in docs) if m[0]]
        assert [tuple(r[:3]) for r in found.tolist()] == expected
        for doc, n, start, item in found.tolist():
            piece = words(docs[doc])[start : start + n]
            assert any(piece == words(t)[j : j + n] for k, t in items if k == item for j in range(len(words(t))))


def test_long_repetitions_take_little(spark):
    import resource
    import time

    import pyarrow as pa

    from lectern.llm.wordarrays import buffers

    tests = decontam.prepare([(1, "a " * 20_000), (2, "a b " * 10_000)])
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    _, hit, pairs, found = decontam.search(tests, *buffers(pa.array(["x " + "a " * 20_000, "a b " * 10_000, "b " * 9])))
    assert hit[1:40_001].all() and not hit[0] and not hit[40_001:].any()
    assert pairs.tolist() == [[0, 1], [1, 2]] and found.tolist() == [[0, 20_000, 1, 1], [1, 20_000, 0, 2]]
    assert time.time() - start < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_long_words_do_not_collide():
    import pyarrow as pa

    from lectern.llm.wordarrays import SOLID, buffers, split_words

    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    a, b = split_words(*buffers(pa.array([word, other])), SOLID).hashes().tolist()
    assert a != b
