"""Density clusters of vectors of one text's terms, and names for them.

Terms of a text are few (a cap bounds them), so each text is clustered in one task; texts run in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tree(points: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of mutual reachability distances, by increasing length."""
    n = len(points)
    square = (points * points).sum(axis=1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0))
    core = np.sort(distance, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(distance, np.maximum(core[:, None], core[None]))
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        nearer = ~inside & (reach[at] < best)
        best[nearer], parent[nearer] = reach[at][nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[at]), int(parent[at]), at))
    return sorted(edges)


def hdbscan(points: np.ndarray, min_size: int, min_samples: int | None = None, leaf: bool = False) -> np.ndarray:
    """Labels from 0 and -1 for noise: hierarchical density clusters (Campello, Moulavi, Sander 2013).

    Clusters are chosen by excess of mass, or as the leaves of the condensed tree.
    """
    n = len(points)
    labels = np.full(n, -1)
    if n < max(2, min_size):
        return labels
    edges = _tree(np.asarray(points, float), min_samples or min_size)
    # Single-linkage merges: nodes n, n + 1, ... with their children and heights.
    top, size, children, height = list(range(n)), {i: 1 for i in range(n)}, {}, {}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    name = list(range(n))
    for k, (d, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        node = n + k
        children[node], height[node], size[node] = (name[a], name[b]), d, size[name[a]] + size[name[b]]
        top[b] = a
        name[a] = node

    def points_of(node):
        stack, out = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += children[x]
        return out

    # Condensed tree: a split counts only if both sides are large enough; else points fall out of the cluster.
    root = n + len(edges) - 1
    born, stability, splits, members, order = {0: 0.0}, {0: 0.0}, {0: []}, {0: points_of(root)}, [0]
    stack, fresh = [(root, 0)], 1
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        level = 1 / max(height[node], 1e-12)
        left, right = children[node]
        large = [c for c in (left, right) if size[c] >= min_size]
        if len(large) == 2:
            stability[cluster] += (level - born[cluster]) * size[node]
            for child in large:
                born[fresh], stability[fresh], splits[fresh], members[fresh] = level, 0.0, [], points_of(child)
                splits[cluster].append(fresh)
                order.append(fresh)
                stack.append((child, fresh))
                fresh += 1
        else:
            for child in (left, right):
                if child in large:
                    stack.append((child, cluster))
                else:
                    stability[cluster] += (level - born[cluster]) * size[child]
    chosen = set()
    best = dict(stability)
    for c in reversed(order):
        below = sum(best[s] for s in splits[c])
        if c == 0:
            break
        if not splits[c] or (not leaf and stability[c] >= below):
            chosen.add(c)
        else:
            best[c] = below
    kept, stack = [], list(splits[0])
    while stack:
        c = stack.pop()
        if c in chosen:
            kept.append(c)
        else:
            stack += splits[c]
    for label, c in enumerate(sorted(kept, key=lambda c: min(members[c]))):
        labels[members[c]] = label
    return labels


def cluster_vectors(rows: DataFrame, key: str, min_size: int = 5, largest: int | None = None, tries: int = 5) -> DataFrame:
    """key, item, label, resplit. Clusters above ``largest`` are clustered again by leaves and replaced if they fall
    into two at least; while one stays too large, the least size is lowered, at most ``tries`` times."""

    def run(table: pa.Table) -> pa.Table:
        items = table.column("item").to_pylist()
        order = sorted(range(len(items)), key=lambda i: items[i])
        points = np.array([table.column("vector")[i].as_py() for i in order], float)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        labels, resplit = hdbscan(points, min_size), np.zeros(len(items), bool)
        for less in range(tries if largest else 0):
            large = [c for c in range(labels.max() + 1) if (labels == c).sum() > largest]
            if not large:
                break
            for c in large:
                inside = np.flatnonzero(labels == c)
                parts = hdbscan(points[inside], max(2, min_size - less), 1, leaf=True)
                if parts.max() >= 1:
                    labels[inside] = np.where(parts < 0, -1, parts + labels.max() + 1)
                    resplit[inside] = True
        return pa.table({key: table.column(key).take(pa.array(order)), "item": pa.array([items[i] for i in order], pa.int64()), "label": pa.array(labels, pa.int32()), "resplit": pa.array(resplit)})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, item bigint, label int, resplit boolean")


def recovered_noise(points: DataFrame, first: int = 20) -> DataFrame:
    """Clusters of noise stems by their occurrences, so that a stem may be in several: doc_id, label, stems.

    points: doc_id, term, item, vector; one for each occurrence. The first occurrences of each stem are clustered, as in
    ``first_occurrences``; the cap on a text's stems bounds its points."""
    order = Window.partitionBy("doc_id", "term").orderBy("item")
    kept = points.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first)
    found = cluster_vectors(kept.select("doc_id", "item", "vector"), "doc_id").filter("label >= 0")
    named = found.join(kept.select("doc_id", "item", "term"), ["doc_id", "item"])
    return named.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("term")).alias("stems"))


def cluster_names(words: DataFrame) -> DataFrame:
    """The most frequent words of each cluster, ties joined in order; equal names of a text are numbered.

    words: doc_id, cluster, word, cnt.
    """
    sums = words.groupBy("doc_id", "cluster", "word").agg(F.sum("cnt").alias("cnt"))
    top = sums.withColumn("r", F.rank().over(Window.partitionBy("doc_id", "cluster").orderBy(F.desc("cnt")))).filter("r = 1")
    named = top.groupBy("doc_id", "cluster").agg(F.array_join(F.array_sort(F.collect_list("word")), " & ").alias("base"))
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("cluster"))
    return named.withColumn("k", again).select("doc_id", "cluster", F.when(F.col("k") > 1, F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("name"))
