"""Operator 9 and connected components against brute force."""

from __future__ import annotations

import random
import re

import pytest

from lectern.llm import jaccard_join
from lectern.llm.components import connected
from lectern.session import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(range(len(sets)), key=lambda i: len(sets[i][1]))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            x, y = sets[i][1], sets[j][1]
            if 100 * len(x) < percent * len(y):
                break
            if x and 100 * len(x & y) >= percent * len(x | y):
                label[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def check(docs, **kw):
    found = sorted(map(tuple, jaccard_join.linked_components(docs, **kw).collect()))
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], **({"percent": kw["percent"]} if "percent" in kw else {}))
    assert found == expected
    return expected


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 530)]
    found = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {n: label[n] for n in found} == found
    assert connected(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_whole_table(spark, sf_dir):
    expected = check(table(spark, sf_dir, "documents"))
    assert len({c for _, _, c in expected}) < len(expected)


def near_copies(seed=5):
    """Chains of copies that drift apart, a passage that many share, and exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    docs = []
    for _ in range(6):
        text = rng.choices(words, k=rng.randint(60, 200))
        for _ in range(rng.randint(8, 30)):
            docs.append(" ".join(text))
            if rng.random() < 0.8:
                text = list(text)
                for _ in range(rng.randint(1, 5)):
                    text[rng.randrange(len(text))] = rng.choice(words)
    docs += [" ".join(rng.choices(words, k=rng.randint(5, 90))) + " " + passage for _ in range(60)]
    docs += ["a b", "A B", "a  b\n", "b a", "x", None, "", " "]
    rng.shuffle(docs)
    return [(i + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("block", [4000, 20])
def test_drifting_copies(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(jaccard_join, "ROUNDS", (1, 2, None))
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(5)
    check(docs, block=block)
    if block == 20:
        check(docs, block=block, percent=60)


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LARGE", 4)
    check(spark.createDataFrame(near_copies(7), "doc_id long, text string").repartition(2))


def test_passages_of_two_texts_make_no_region(spark, monkeypatch):
    rng = random.Random(11)
    texts = [[f"w{i}x{j}" for j in range(200)] for i in range(40)]
    for i, j in [(i, (i + k) % 40) for i in range(40) for k in (1, 7)]:
        passage = [f"p{rng.random()}" for _ in range(8)]
        texts[i], texts[j] = texts[i] + passage, passage + texts[j]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    stored, regions = jaccard_join.stored, []

    def counted(df, name, *rest):
        out = stored(df, name, *rest)
        regions.extend([out.count()] if name == "join-regions" else [])
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    check(docs)
    assert regions == [0]


def near_groups(sizes, common=200, own=24):
    """Groups of texts with a long passage in common that are near, but not linked."""
    texts = [[f"c{g}x{j}" for j in range(common)] + [f"o{g}x{i}x{j}" for j in range(own)] for g, size in enumerate(sizes) for i in range(size)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def counts(monkeypatch, step, of=lambda df: df.count()):
    stored, found = jaccard_join.stored, []

    def counted(df, name, *rest):
        out = stored(df, name, *rest)
        found.extend([of(out)] if name == step else [])
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    return found


def test_regions_of_the_same_classes_are_one(spark, monkeypatch):
    docs = spark.createDataFrame(near_groups([3] * 6), "doc_id long, text string").repartition(3)
    found = counts(monkeypatch, "join-regions")
    assert len({c for _, _, c in check(docs)}) == 18
    # A group's texts have nested parts of one order, so that their regions hold all three or one pair.
    assert 6 <= found[0] <= 12


def test_finished_regions_have_no_further_round(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LARGE", 1000)
    monkeypatch.setattr(jaccard_join, "ROUNDS", (1, 2, None))
    docs = spark.createDataFrame(near_groups([3] * 6 + [9], own=18), "doc_id long, text string").repartition(3)
    found = counts(monkeypatch, "join-open", lambda df: df.select("key").distinct().count())
    check(docs)
    assert len(found) > 1 and found[1] <= 9 < found[0]


def test_classes_late_in_their_region_leave_it(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WIDER", 10)
    docs = spark.createDataFrame(near_groups([3] * 6, own=20), "doc_id long, text string").repartition(3)
    found = counts(monkeypatch, "join-open")
    check(docs)
    assert found == [0]


def test_edges(spark, edge_docs, empty_docs):
    check(edge_docs)
    assert jaccard_join.linked_components(empty_docs).count() == 0


def test_recursion_misses_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(12)]
    sets = []
    for i in range(400):
        s = base[i % 12].copy()
        s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(s))
    histograms = np.stack([np.frombuffer(jaccard_join.histogram(s), np.uint8) for s in sets]).astype(np.int16)
    nothing = np.zeros(400, np.int64)
    region = jaccard_join.Region(histograms, np.array([len(s) for s in sets]), nothing, np.arange(400), nothing + 2, 85)
    region.join(np.arange(350), np.arange(350, 400))
    found = [tuple(sorted(p)) for x in region.pairs for p in x[:, :2].tolist()]
    linked = set()
    for i in range(400):
        for j in range(min(i, 350)):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                linked.add((j, i))
    assert linked and linked <= set(found)
    assert len(found) == len(set(found)) < 0.2 * 400 * 400 / 2
    few = jaccard_join.Region(histograms, np.array([len(s) for s in sets]), nothing, np.arange(400), nothing + 2, 85, 2)
    few.test(np.arange(400), np.arange(400))
    near = np.concatenate(few.pairs)
    assert few.more and np.bincount(near[:, 0]).max() == 2
    assert {tuple(sorted(p)) for p in near[:, :2].tolist()} <= set(found) | {tuple(sorted(p)) for p in near[:, :2].tolist() if min(p) >= 350}
