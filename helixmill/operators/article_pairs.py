"""Pairs of the mentions of an article, aggregated where the article is read.

Mentions meet by article in one shuffle and are ordered there; pairs, the node of each text, counts, articles and jobs of
each edge are found by Arrow batches of whole articles, and only what a batch adds to an edge goes on. An article has one
``article_seq``, a whole number. Batches hold a bounded number of pairs; an article of more is taken in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mentions and pairs that are worked on at a time, and mentions of which only nodes are.
ROWS, PAIRS, LINKED = 300_000, 2_000_000, 1_000_000


def by_article(mentions: DataFrame, **columns: Column) -> DataFrame:
    """Mentions in the order of articles, each article in one partition: article_seq, pmid, job_id, node_id, ``columns``, n (1
    at an article's first mention) and r (that of the first of equal seq)."""
    w = Window.partitionBy("article_seq", "pmid").orderBy("type_seq", "entity_seq")
    m = mentions.filter("pmid is not null").withColumns(columns)
    return m.select(F.col("article_seq").cast("long").alias("article_seq"), "pmid", "job_id", "node_id", *columns, F.row_number().over(w).alias("n"), F.rank().over(w).alias("r"))


def whole_articles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to so many rows at least, cut between articles."""
    held: list[pa.RecordBatch] = []
    size, wanted = 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(t.column("n").to_numpy() == 1)[-1])
        if cut == 0:  # one article so far: look again when it has doubled
            wanted = 2 * size
            continue
        yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        size, wanted = t.num_rows - cut, rows
    if size:
        yield pa.Table.from_batches(held)


def codes(column: pa.ChunkedArray, ordered: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, -1 for null, and the values; ordered: as their bytes are."""
    encoded = column.combine_chunks().dictionary_encode()
    values = encoded.dictionary
    found = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if ordered and len(values):
        order = pc.sort_indices(values.cast(pa.binary()))
        rank = np.empty(len(values) + 1, dtype=np.int64)
        rank[order.to_numpy()], rank[-1] = np.arange(len(values)), -1
        return rank[found], values.take(order)
    return found, values


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, dtype=np.int64)


def _lists(keys: np.ndarray, owner: np.ndarray, values: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Lists of structs for each of the sorted ``keys``; ``owner``, sorted, tells whose each is."""
    return pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(owner, keys), len(owner)].astype(np.int32)), pa.StructArray.from_arrays(values, names))


class _Articles:
    """Columns of whole articles as numbers."""

    def __init__(self, t: pa.Table, by_relation: bool):
        n, r = t.column("n").to_numpy(), t.column("r").to_numpy()
        self.size = len(n)
        self.starts = np.flatnonzero(n == 1)
        self.article = np.cumsum(n == 1) - 1
        ends = np.r_[self.starts[1:], self.size]
        node, self.nodes = codes(t.column("node_id"), ordered=True)
        key, keys = codes(t.column("key"))
        # of equal texts of an article the last mention's node counts
        _, same = np.unique(self.article * (len(keys) + 1) + key, return_inverse=True)
        last = np.empty(self.size, dtype=np.int64)
        last[same] = np.arange(self.size)
        self.node = node[last[same]]
        # the partners of a mention are those of greater seq
        first = np.r_[np.flatnonzero(n == r), self.size]
        self.partner = np.minimum(first[np.searchsorted(first, np.arange(self.size), "right")], ends[self.article])
        self.count = ends[self.article] - self.partner
        self.relation, self.relations = codes(t.column("relation"))
        self.job, self.jobs = codes(t.column("job_id"))
        self.pmid, self.seq = t.column("pmid").combine_chunks(), t.column("article_seq").to_numpy()
        self.named = np.asarray(pc.not_equal(self.pmid, "").to_numpy(zero_copy_only=False), dtype=bool)
        self.by_relation = by_relation

    def parts(self, pairs: int) -> Iterator[list[tuple[int, int]]]:
        """Ranges of mentions of whole articles with so many pairs at most; one article with more as several ranges."""
        before = np.r_[0, np.cumsum(self.count)]
        bounds = np.r_[self.starts, self.size]
        a = 0
        while a < len(self.starts):
            b = max(int(np.searchsorted(before[bounds], before[bounds[a]] + pairs, "right")) - 1, a + 1)
            lo, hi = int(bounds[a]), int(bounds[b])
            ranges = []
            while lo < hi:
                mid = min(max(int(np.searchsorted(before, before[lo] + pairs, "right")) - 1, lo + 1), hi)
                ranges.append((lo, mid))
                lo = mid
            yield ranges
            a = b

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(edge, earlier mention) of the pairs whose earlier mention is in [lo, hi), by edge and then in their order."""
        count = self.count[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.partner[lo:hi], count)
        a, b = self.node[i], self.node[j]
        good = (a != b) & (a >= 0) & (b >= 0)
        a, b, i = a[good], b[good], i[good]
        edge = np.minimum(a, b) * len(self.nodes) + np.maximum(a, b)
        if self.by_relation:
            edge = edge * (len(self.relations) + 1) + self.relation[i] + 1
        order = np.argsort(edge, kind="stable")
        return edge[order], i[order]

    def edges(self, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Of each edge its weight and first mention; then of each of its articles, and of each of its jobs, the edge and the first mention."""
        found = []
        for lo, hi in ranges:
            edge, i = self.pairs(lo, hi)
            start = _runs(edge)
            new = np.zeros(len(edge), dtype=bool)
            new[start] = True
            new[1:] |= self.article[i[1:]] != self.article[i[:-1]]
            changed = new.copy()
            changed[1:] |= self.job[i[1:]] != self.job[i[:-1]]
            found.append((edge[start], np.diff(np.r_[start, len(edge)]), i[start], edge[new], i[new], *self._once(edge[changed], i[changed])))
        if len(found) == 1:
            return found[0]
        # parts of one article: an edge of several parts counts once
        edge, weight, first, _, _, job_edge, job_at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(edge, kind="stable")
        edge, first = edge[order], first[order]
        start = _runs(edge)
        weight = np.add.reduceat(weight[order], start) if len(start) else weight
        order = np.argsort(job_edge, kind="stable")
        return edge[start], weight, first[start], edge[start], first[start], *self._once(job_edge[order], job_at[order])

    def _once(self, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each job of an edge the first mention; sorted by edge, as what comes in."""
        start = _runs(edge)
        run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(edge)]))
        first = np.sort(np.unique(run * (len(self.jobs) + 1) + self.job[at] + 1, return_index=True)[1])
        return edge[first], at[first]


def edge_parts(by_relation: bool, lists: bool, jobs: bool, rows: int = ROWS, pairs: int = PAIRS):
    """What each batch of articles adds to each edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_articles(batches, rows):
            x = _Articles(t, by_relation)
            for ranges in x.parts(pairs):
                edge, weight, first, article_edge, article_at, job_edge, job_at = x.edges(ranges)
                if not len(edge):
                    continue
                named = x.named[article_at]
                article_edge, article_at = article_edge[named], article_at[named]
                pair = edge // (len(x.relations) + 1) if by_relation else edge
                relation = pa.array(x.relation[first], mask=x.relation[first] < 0)
                n = np.diff(np.r_[np.searchsorted(article_edge, edge), len(article_edge)])
                out = [x.nodes.take(pa.array(pair // len(x.nodes))), x.nodes.take(pa.array(pair % len(x.nodes))), x.relations.take(relation), pa.array(weight), pa.array(n), pa.array(x.seq[first])]
                names = ["source_id", "target_id", "relation", "weight", "n_sources", "first"]
                if lists:
                    out.append(_lists(edge, article_edge, [pa.array(x.seq[article_at]), x.pmid.take(pa.array(article_at))], ["article_seq", "pmid"]))
                    names.append("articles")
                if jobs:
                    out.append(_lists(edge, job_edge, [pa.array(x.seq[job_at]), x.jobs.take(pa.array(x.job[job_at], mask=x.job[job_at] < 0))], ["article_seq", "job_id"]))
                    names.append("jobs")
                batch = pa.RecordBatch.from_arrays(out, names)
                for at in range(0, batch.num_rows, 10_000):
                    yield batch.slice(at, 10_000)

    return run


def schema(lists: bool, jobs: bool) -> str:
    return "source_id string, target_id string, relation string, weight long, n_sources long, first long" + ", articles array<struct<article_seq: long, pmid: string>>" * lists + ", jobs array<struct<article_seq: long, job_id: string>>" * jobs


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, target_id): each node that articles of a batch join to others, and the least of those."""
    for t in whole_articles(batches, LINKED):
        node, nodes = codes(t.column("node_id"), ordered=True)
        first = t.column("n").to_numpy() == 1
        article = (np.cumsum(first) - 1)[node >= 0]
        node = node[node >= 0]
        start = _runs(article)
        if not len(start):
            continue
        least = np.repeat(np.minimum.reduceat(node, start), np.diff(np.r_[start, len(node)]))
        pair = np.unique(least * len(nodes) + node)
        a, b = pair // len(nodes), pair % len(nodes)
        root = np.arange(len(nodes))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            np.minimum.at(new, root, new.copy())  # what a node finds is good for its root
            new = new[new]
            if (new == root).all():
                break
            root = new
        joined = np.flatnonzero(root != np.arange(len(nodes)))
        batch = pa.RecordBatch.from_arrays([nodes.take(pa.array(root[joined])), nodes.take(pa.array(joined))], ["source_id", "target_id"])
        for at in range(0, batch.num_rows, 10_000):
            yield batch.slice(at, 10_000)
