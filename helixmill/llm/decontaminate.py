"""Benchmark decontamination by winnowing.

Both sides keep the least ``GRAM``-word hash of every ``WINDOW`` consecutive ones, so that texts which share
``GRAM + WINDOW - 1`` = 13 words in a row share a fingerprint. Fingerprints that join are extended to both sides, word
by word; a document and an item match when the longest shared span has ``MIN_SPAN`` words or more.

The benchmark's fingerprints and words go to every task while they take no more than ``MAX_BROADCAST_BYTES``, which is
counted first; the documents are then read once and never shuffled. A larger benchmark is joined by shuffling
fingerprints, and the texts of the documents and items that have one in common, with the same result.

Defined results. Null texts and rows of null id match nothing; an item of fewer than ``MIN_SPAN`` words is too short to
be recognised. Rows that repeat a doc_id (or item_id) are one document (item) to ``contaminated``: the longest span of any
of its rows counts, of spans of one length the first in the document, then in the item; ``without_contaminated`` judges each
row by its own text. Texts are searched whole. Other columns are ignored. Against an
empty benchmark nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._rows import text_hash, without_rows
from helixmill.llm._text import Words, chunks, grams, winnow

GRAM = 6
WINDOW = 8
MIN_SPAN = GRAM + WINDOW - 1
MAX_BROADCAST_BYTES = 64 << 20
_MATCH = "doc_id long, item_id long, span_words int, doc_start int, item_start int"


def _prints(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the words at which fingerprints begin, and the fingerprints."""
    w = Words(texts)
    h, ok = grams(w, GRAM)
    at = winnow(h, ok, w.doc, WINDOW)
    return w, at, h[at]


def _extend(a: np.ndarray, b: np.ndarray, at: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """The longest span around any of the hits (i, j) that ``a`` and ``b`` share: length, start in a, start in b."""
    best: tuple[int, int, int] | None = None
    reached: dict[int, int] = {}
    for i, j in sorted(at):
        if reached.get(i - j, -1) > i:
            continue
        back, n = min(i, j), min(len(a) - i, len(b) - j)
        same = a[i : i + n] == b[j : j + n]
        right = n if same.all() else int(same.argmin())
        same = (a[i - back : i] == b[j - back : j])[::-1]
        left = back if same.all() else int(same.argmin())
        reached[i - j] = i + right
        found = (right + left, i - left, j - left)
        if right >= GRAM and (best is None or (-found[0], *found[1:]) < (-best[0], *best[1:])):
            best = found
    return best if best and best[0] >= MIN_SPAN else None


class _Items:
    """A benchmark in memory: its fingerprints in order of hash, and the words of each item."""

    def __init__(self, ids: list[int], texts: list[str]):
        w, at, h = _prints(pa.array(texts, pa.string()))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], w.doc[at][order], (at - w.first[w.doc[at]])[order]
        self.ids, self.hash, self.first = ids, w.hash, w.first

    def matches(self, doc: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """doc: word hashes; hits: (word of the document, index of fingerprint)."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for i, f in hits:
            by_item.setdefault(int(self.item[f]), []).append((i, int(self.pos[f])))
        for item, at in by_item.items():
            if best := _extend(doc, self.hash[self.first[item] : self.first[item + 1]], at):
                yield self.ids[item], *best


def _matches(items: _Items, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """The items that each text matches, with their spans."""
    w, at, h = _prints(texts)
    lo, hi = np.searchsorted(items.h, h, "left"), np.searchsorted(items.h, h, "right")
    hits: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(hi > lo):
        d = int(w.doc[at[k]])
        hits.setdefault(d, []).extend((int(at[k] - w.first[d]), f) for f in range(lo[k], hi[k]))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(texts))]
    for d, found in hits.items():
        out[d] = list(items.matches(w.hash[w.first[d] : w.first[d + 1]], found))
    return out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(d, *m) for d, found in zip(part.column("doc_id").to_pylist(), _matches(shared.value, part.column("text"))) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "span_words", "doc_start", "item_start"])

    return run


def _fingerprints(ids: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w, at, h = _prints(part.column("text"))
                rows = pa.array(w.doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(part.column(c).take(rows) for c in ids)], ["h", *ids])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the items that they share a fingerprint with."""
    for batch in batches:
        rows = []
        for doc_id, th, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "items"))):
            rows += [(doc_id, th, *m) for m in _matches(_Items([i["item_id"] for i in items], [i["text"] for i in items]), pa.array([text], pa.string()))[0]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "th", "item_id", "span_words", "doc_start", "item_start"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("item_id is not null and text is not null")


def _shared(items: DataFrame, most: int):
    """The benchmark for every task, or None if it takes more than ``most`` bytes."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size * 4 > most:  # a word of six bytes takes eight, and its fingerprints some more
        return None
    rows = items.orderBy("item_id").collect()
    return items.sparkSession.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows]))


def _found_by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matches with th, the hash of the row's text: fingerprints meet by a shuffle, then each document that has some meets
    its items' texts at once."""
    rows = docs.select("doc_id", text_hash().alias("th"), "text")
    prints = rows.mapInArrow(_fingerprints(("doc_id", "th")), "h long, doc_id long, th long")
    tests = items.mapInArrow(_fingerprints(("item_id",)), "h long, item_id long").distinct()
    pairs = prints.join(tests, "h").select("doc_id", "th", "item_id").distinct()
    of_doc = pairs.join(items, "item_id").groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    return of_doc.join(rows, ["doc_id", "th"]).select("doc_id", "th", "text", "items").mapInArrow(_verify, _MATCH.replace("doc_id long,", "doc_id long, th long,"))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, span_words, doc_start, item_start) of each document and item that share a long span."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = _items(benchmark)
    shared = _shared(items, max_broadcast_bytes)
    found = docs.mapInArrow(_search(shared), _MATCH) if shared is not None else _found_by_shuffle(docs, items)
    best = F.max(F.struct("span_words", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.span_words", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that share a long span with the benchmark; rows of null doc_id or text stay.

    While the benchmark goes to every task, rows are judged where they are read and no document is shuffled.
    """
    items = _items(benchmark)
    shared = _shared(items, max_broadcast_bytes)
    if shared is None:
        known = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
        return without_rows(docs, _found_by_shuffle(known, items).select("doc_id", F.col("th").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                known = np.asarray(pc.is_valid(part.column("doc_id")))
                clean = np.array([not m for m in _matches(shared.value, part.column("text"))], bool)
                yield part.filter(pa.array(clean | ~known))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB's equal: shared 13-word grams, and runs of them on one diagonal.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dp AS (SELECT doc_id, CAST(unnest(range(0, len(w) - 12)) AS INTEGER) AS p, w FROM d WHERE len(w) >= 13),
bp AS (SELECT item_id, CAST(unnest(range(0, len(w) - 12)) AS INTEGER) AS q, w FROM b WHERE len(w) >= 13),
dg AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS g FROM dp),
bg AS (SELECT item_id, q, array_to_string(w[q + 1 : q + 13], ' ') AS g FROM bp),
m AS (SELECT doc_id, item_id, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run
      FROM dg JOIN bg USING (g)),
s AS (SELECT doc_id, item_id, min(p) AS doc_start, min(q) AS item_start, CAST(count(*) + 12 AS INTEGER) AS span_words
      FROM m GROUP BY doc_id, item_id, p - q, run)
SELECT doc_id, item_id, span_words, doc_start, item_start FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY span_words DESC, doc_start, item_start) AS k FROM s)
WHERE k = 1
"""
