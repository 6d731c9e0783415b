"""Exact top-k search (BM25) by block-at-a-time pruning.

Documents go into blocks of ``BLOCK`` in their order; a block has a forward index of the query terms its documents hold.
Per query, the blocks of a task are ordered by the sum of their terms' highest contributions, and scored through their
forward indexes until the next sum is below the k-th score so far. No later block can hold a better document, so the
result is that of scoring all. The tasks' best meet in one window per query.

The index is built once, of the terms of all queries, while these take no more than ``VOCABULARY_BYTES``, which is counted
first; more of them are indexed by groups of queries. Queries go to the tasks in groups of ``QUERIES`` or ``QUERY_BYTES`` of
text; a pass over the index first searches one block in ``SAMPLE``, whose k-th scores are where every task of the second pass
starts from: a document below them is among the k best of none. A task holds ``STEP`` blocks at a time, and the best so far.

Contributions are rounded to millionths and added as whole numbers, so that scores don't depend on the order of adding.
Equal scores go by doc_id. Document counts, lengths and frequencies are of all documents. Every row of the query table is a
query, however many there are.

Defined results. Null texts and rows of null id are no documents and no queries. An empty document has no terms but
counts; a query without a term that a document holds has no rows. Rows that repeat are documents, or queries, each for
itself. Texts are indexed whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._text import Words, chunks
from helixmill.session import cut

K = 10
K1, B = 1.2, 0.75
BLOCK = 64
QUERIES, QUERY_BYTES = 1 << 17, 16 << 20
VOCABULARY_BYTES = 64 << 20
SAMPLE, STEP = 16, 256
UNIT = 1_000_000
_BLOCKS = "n int, doc_ids binary, lengths binary, owners binary, terms binary, counts binary"


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: np.ndarray = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                n, length = part.num_rows, np.diff(w.first)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                ok = vocabulary[at] == w.hash
                key, count = np.unique(w.doc[ok] * len(vocabulary) + at[ok], return_counts=True)
                doc, term = key // len(vocabulary), (key % len(vocabulary)).astype("<i4")
                ids = part.column("doc_id").to_numpy()
                rows = []
                for a in range(0, n, BLOCK):
                    b = min(a + BLOCK, n)
                    x, y = np.searchsorted(doc, (a, b))
                    rows.append((b - a, ids[a:b].astype("<i8").tobytes(), length[a:b].astype("<i8").tobytes(), (doc[x:y] - a).astype("<u1").tobytes(), term[x:y].tobytes(), count[x:y].astype("<i4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], ["n", "doc_ids", "lengths", "owners", "terms", "counts"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for terms, lengths in zip(batch.column("terms").to_pylist(), batch.column("lengths").to_pylist()):
                df += np.bincount(np.frombuffer(terms, "<i4"), minlength=size)
                words += int(np.frombuffer(lengths, "<i8").sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[df[some], n, words])], ["term", "n"])

    return run


class Searcher:
    """Queries as lists of terms with their counts, and what BM25 needs to know of the collection."""

    def __init__(self, query: np.ndarray, term: np.ndarray, times: np.ndarray, n_queries: int, df: np.ndarray, n_docs: int, n_words: int):
        edge = np.searchsorted(query, np.arange(n_queries + 1))
        self.terms = [term[a:b] for a, b in zip(edge[:-1], edge[1:])]
        self.times = [times[a:b].astype(np.float64) for a, b in zip(edge[:-1], edge[1:])]
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        self.mean = n_words / n_docs if n_words else 1.0
        #: Scores below which a document is among no query's best.
        self.least = np.zeros(n_queries)

    def parts(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids of a block; and owner, term and contribution of each posting."""
        owner, term = np.frombuffer(row["owners"], "<u1").astype(np.int64), np.frombuffer(row["terms"], "<i4")
        tf, length = np.frombuffer(row["counts"], "<i4").astype(float), np.frombuffer(row["lengths"], "<i8").astype(float)
        norm = K1 * (1 - B + B * length / self.mean)
        value = np.floor(UNIT * (self.idf[term] * tf * (K1 + 1) / (tf + norm[owner])) + 0.5)
        return np.frombuffer(row["doc_ids"], "<i8"), owner, term, value

    def search(self, rows: Iterable[dict], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, doc_ids, scores) of the k best of some blocks; ``scored`` counts the blocks that were scored."""
        self.scored = 0
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows = iter(rows)
        while some := list(islice(rows, STEP)):
            self._search(some, k, best)
        yield from ((q, *found) for q, found in sorted(best.items()))

    def _search(self, rows: list[dict], k: int, best: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        blocks = [self.parts(r) for r in rows]
        # the highest contribution of each term in each block, by term
        key = np.concatenate([term.astype(np.int64) * len(blocks) + b for b, (_, _, term, _) in enumerate(blocks)])
        value = np.concatenate([v for *_, v in blocks])
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        most, term, of = np.maximum.reduceat(value, first), key[first] // len(blocks), key[first] % len(blocks)
        weight = np.zeros(len(self.idf))
        for q, (terms, times) in enumerate(zip(self.terms, self.times)):
            lo, hi = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bound = np.bincount(of[at], most[at] * np.repeat(times, n), len(blocks))
            ids, scores = best.get(q, (np.zeros(0, np.int64), np.zeros(0)))
            least = max(self.least[q], scores[-1] if len(scores) == k else 0.0)
            some = np.flatnonzero((bound > 0) & (bound >= least))
            if not len(some):
                continue
            weight[terms] = times
            for b in some[np.argsort(-bound[some], kind="stable")]:
                if bound[b] < least:
                    break
                self.scored += 1
                doc, owner, held, value = blocks[b]
                total = np.bincount(owner, value * weight[held], len(doc))
                good = np.flatnonzero((total > 0) & (total >= least))
                if len(good):
                    ids, scores = np.r_[ids, doc[good]], np.r_[scores, total[good]]
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                    if len(ids) == k:
                        least = max(least, scores[-1])
            weight[terms] = 0
            if len(ids):
                best[q] = ids, scores


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(shared.value.search((r for batch in batches for r in batch.to_pylist()), k))
        if found:
            query = np.concatenate([np.full(len(i), q) for q, i, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64))], ["q", "doc_id", "units"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(part.column("text")).hash).view(np.int64))], ["h"])


def _groups(rows: Iterator) -> Iterator[list]:
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += len(r["text"])
        if len(group) >= QUERIES or size >= QUERY_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Index:
    """Blocks of documents with the terms of ``vocabulary`` (hashes in order), and counts over all documents."""

    def __init__(self, docs: DataFrame, vocabulary: np.ndarray):
        spark = docs.sparkSession
        self.vocabulary = vocabulary
        self.blocks = cut(docs.mapInArrow(_index(spark.sparkContext.broadcast(vocabulary)), _BLOCKS))
        stats = self.blocks.select("n", "terms", "lengths").mapInArrow(_frequencies(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = stats.column("term").to_numpy(), stats.column("n").to_numpy()
        self.df = np.zeros(len(vocabulary))
        self.df[term[term >= 0]] = n[term >= 0]
        self.n_docs, self.n_words = (int(n[term == -x].sum()) for x in (1, 2))

    def search(self, group: list, k: int) -> DataFrame | None:
        spark = self.blocks.sparkSession
        w = Words(pa.array([r["text"] for r in group], pa.string()))
        size = len(self.vocabulary)
        key, times = np.unique(w.doc * size + np.searchsorted(self.vocabulary, w.hash), return_counts=True)
        if not len(key):
            return None
        searcher = Searcher(key // size, key % size, times, len(group), self.df, self.n_docs or 1, self.n_words)
        best = Window.partitionBy("q").orderBy(F.desc("units"), "doc_id")
        ranked = lambda blocks: blocks.mapInArrow(_search(spark.sparkContext.broadcast(searcher), k), "q long, doc_id long, units long").withColumn("rank", F.row_number().over(best))
        least = ranked(self.blocks.filter(F.pmod(F.xxhash64("doc_ids", "lengths"), F.lit(SAMPLE)) == 0)).filter(F.col("rank") == k).select("q", "units").toArrow()
        searcher.least[least.column("q").to_numpy()] = least.column("units").to_numpy()
        ids = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(group))), "item_id": pa.array([r["item_id"] for r in group], pa.int64())}))
        top = ranked(self.blocks).filter(F.col("rank") <= k)
        return top.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", (F.col("units") / UNIT).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each row of ``queries`` (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    rows = queries.select("item_id", "text").filter("item_id is not null and text is not null")
    terms = cut(rows.select("text").mapInArrow(_hashes, "h long").distinct())
    index, size = None, terms.count()
    if 0 < size * 8 <= VOCABULARY_BYTES:
        index = Index(docs, np.sort(terms.toArrow().column("h").to_numpy().view(np.uint64)))
    out = None
    for group in _groups(rows.orderBy("item_id", "text").toLocalIterator()) if size else ():
        words = np.unique(Words(pa.array([r["text"] for r in group], pa.string())).hash)
        found = (index or Index(docs, words)).search(group, k) if len(words) else None
        if found is not None:
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score double") if out is None else out


#: DuckDB's equal, by scoring all documents.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS mean FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id,
        unnest(regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+')) AS t
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
c AS (SELECT doc_id, t, CAST(floor(1000000 * (ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) + 0.5) AS BIGINT) AS units
      FROM p JOIN f USING (t) CROSS JOIN s),
r AS (SELECT item_id, doc_id, CAST(sum(units * times) AS BIGINT) AS units FROM c JOIN q USING (t) GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY units DESC, doc_id) AS INTEGER) AS rank FROM r WHERE units > 0)
SELECT item_id, rank, doc_id, units / 1000000.0 AS score FROM k WHERE rank <= 10
"""
