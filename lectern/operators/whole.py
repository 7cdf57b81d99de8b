"""Operations on one text at a time, in Python: its top words, and which of its terms stand near each other.

Tokens and their places stay in the worker; only what is found leaves it. So texts are dealt once, by doc_id, and nothing
that is larger than the texts is shuffled or spilled. Rows of one doc_id count as one text, whose tokens share places."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.porter import known_stem
from lectern.functions.words import FUNCTION_WORDS, TOKEN

_TOKEN, _FUNCTION_WORDS = re.compile(TOKEN), frozenset(FUNCTION_WORDS)


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt by doc_id once: what is then grouped or joined by text stays where it is."""
    return docs.select("doc_id", "text").repartition("doc_id")


def _by_text(texts: DataFrame) -> DataFrame:
    return texts.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def _words(texts: list[str]) -> list[list[str]]:
    return [[t.lower() for t in _TOKEN.findall(text)] for text in texts]


def ranked_stems(words: list[list[str]], share: float, most: int) -> list[dict]:
    """The cut of ``rank_cut`` on content stems: stem, cnt, first_pos, rank, and words, how often each word of the stem stands in
    the text, whether content or not; hits and first_place are of the words that are purely alphabetic."""
    count, first = Counter(), {}
    for w in words:
        count.update(w)
        for word, pos in dict(zip(reversed(w), range(len(w) - 1, -1, -1), strict=True)).items():
            first[word] = min(pos, first.get(word, pos))
    by_stem = defaultdict(list)
    for word, n in count.items():
        by_stem[known_stem(word)].append((word, n))
    found = []
    for stem, members in by_stem.items():
        plain = [(n, first[w], w) for w, n in members if "'" not in w]
        content = [(n, p) for n, p, w in plain if w not in _FUNCTION_WORDS]
        if content:
            found.append({"stem": stem, "cnt": sum(n for n, _ in content), "first_pos": min(p for _, p in content), "hits": sum(x[0] for x in plain), "first_place": min(x[1] for x in plain), "words": [w for w, _ in members]})
    found.sort(key=lambda x: (-x["cnt"], x["first_pos"]))
    found = found[: min(math.ceil(len(found) * (1.0 - share)), most)]
    for rank, x in enumerate(found, 1):
        x["rank"] = rank
    return found


def near_pairs(words: list[list[str]], top: list[dict], k: int, size: int, n: int) -> list[dict]:
    """Pairs of terms of different clusters, a cluster's terms being its ``size`` most frequent ones: places of the first within
    n of one of the second, and whether a term is so frequent (five times the upper median) that it is near everything."""
    pool, taken = [], Counter()
    for x in sorted(top, key=lambda x: (-x["hits"], x["first_place"])):
        cluster = f"cluster_{x['rank'] % k}"
        taken[cluster] += 1
        if taken[cluster] <= size:
            pool.append((x, cluster))
    named = {w: i for i, (x, _) in enumerate(pool) for w in x["words"] if "'" not in w}
    places = sorted({(pos, named[word]) for w in words for pos, word in enumerate(w) if word in named})
    hits = defaultdict(set)
    for i, (pos, a) in enumerate(places):
        for j in range(i + 1, len(places)):
            other, b = places[j]
            if other - pos > n:
                break
            if other != pos:
                if pool[a][1] < pool[b][1]:
                    hits[a, b].add(pos)
                elif pool[b][1] < pool[a][1]:
                    hits[b, a].add(other)
    often = 5 * sorted(x["hits"] for x, _ in pool)[len(pool) // 2] if pool else 0
    return [{"term_a": pool[a][0]["stem"], "cluster_a": pool[a][1], "term_b": pool[b][0]["stem"], "cluster_b": pool[b][1], "hits": len(there), "confounded": max(pool[a][0]["hits"], pool[b][0]["hits"]) >= often} for (a, b), there in hits.items()]


_TOP = pa.list_(pa.struct([("stem", pa.string()), ("cnt", pa.int64()), ("first_pos", pa.int32()), ("rank", pa.int64()), ("hits", pa.int64()), ("words", pa.list_(pa.string()))]))
_PAIRS = pa.list_(pa.struct([("term_a", pa.string()), ("cluster_a", pa.string()), ("term_b", pa.string()), ("cluster_b", pa.string()), ("hits", pa.int64()), ("confounded", pa.bool_())]))


def _each(texts: DataFrame, make, kind: pa.DataType, sql: str) -> DataFrame:
    """doc_id and what ``make`` finds in the words of each text."""
    column = F.arrow_udf(lambda rows: pa.array([make(_words(x.as_py())) for x in rows], kind), sql)
    return _by_text(texts).select("doc_id", F.explode(column("texts")).alias("x")).select("doc_id", "x.*")


def top_words(texts: DataFrame, share: float, most: int, k: int = 3) -> DataFrame:
    """doc_id, stem, cnt, first_pos, rank, hits, words of the top stems, and the cluster that ``pseudo_clusters`` gives them."""
    rows = _each(texts, lambda w: ranked_stems(w, share, most), _TOP, "array<struct<stem:string,cnt:long,first_pos:int,rank:long,hits:long,words:array<string>>>")
    return rows.withColumn("cluster", F.concat(F.lit("cluster_"), (F.col("rank") % k).cast("string")))


def collocation_pairs(texts: DataFrame, share: float, most: int, n: int, k: int = 3, size: int = 6) -> DataFrame:
    """doc_id, term_a, cluster_a, term_b, cluster_b, hits, confounded; texts without an id have none."""
    pairs = "array<struct<term_a:string,cluster_a:string,term_b:string,cluster_b:string,hits:long,confounded:boolean>>"
    return _each(texts.filter("doc_id is not null"), lambda w: near_pairs(w, ranked_stems(w, share, most), k, size, n), _PAIRS, pairs)


def clusters_of_words(top: DataFrame) -> DataFrame:
    """doc_id and named: a map from each word of a text's top stems to cluster and stem."""
    entries = top.filter("doc_id is not null").select("doc_id", F.transform("words", lambda w: F.struct(w.alias("word"), F.struct("cluster", "stem").alias("x"))).alias("entries"))
    return entries.groupBy("doc_id").agg(F.map_from_entries(F.flatten(F.collect_list("entries"))).alias("named"))
