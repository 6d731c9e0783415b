"""Repeated passages by a logarithmic family of sparse suffix arrays.

A passage is ``MIN_WORDS`` words in a row. Its anchor is the least hash of the ``GRAM``-word grams in it (the last of equal
ones), so that equal passages have equal anchors at equal places, and neighbouring passages mostly share one. A record
holds the passages of one anchor: the gram's hash, the document, where the first passage begins, and a 64-bit hash of each
passage's words. Every passage stands in one record. Records of equal gram meet in one partition, in document order.

There the suffixes at which passages begin are kept in suffix arrays, in the order of the hashes of their first
``MIN_WORDS`` words: two suffixes have a common prefix of at least that length if and only if these are equal, and longer
matches are runs of such suffixes. Each new batch gets its suffix array and is merge-scanned against every level; what
stands in none becomes a level of its own, and levels of equal size merge, and again, so that there are about log2(n) of
them. No suffix is compared with more than one other at a level, however often a passage occurs.

``Family`` keeps the records of what was added so far as Parquet levels in a folder, which merge likewise; a further batch
is scanned against them.

Result: one row for each maximal run of words in which every word lies in a passage that stands earlier: in a document of
smaller doc_id, or before in the same; or, with a family, in an earlier batch. ``source_doc_id`` is the least of the
doc_ids at which the run's passages stand first. Words are counted from 0, ``end_word`` is the first after the run.

Defined results. Null texts, texts of fewer words and rows of null doc_id have no row. Rows that repeat a doc_id are parts
of one document, of which equal passages at one place count once: a row that repeats doc_id and text finds nothing in its
twin. Very long texts are treated whole. Other columns are ignored. Empty tables have no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm._text import Words, chunks, span_grams
from helixmill.session import cut, newest, remove

MIN_WORDS = 50
GRAM = 32
#: Grams of a passage, of which one is its anchor.
SPREAD = MIN_WORDS - GRAM + 1
#: Records of a new batch within a task.
BATCH = 1 << 15
#: Parts of a partition that are indexed one after the other, so that a task holds one part's levels.
PARTS = 16
_RECORD = "h long, doc_id long, start int, keys binary"
_FOUND = "doc_id long, start_word int, end_word int, source_doc_id long"


def _least(h: np.ndarray) -> np.ndarray:
    """Place of the last least of each SPREAD values in a row."""
    value, place, width = h, np.arange(len(h)), 1
    while width < SPREAD:
        step = min(width, SPREAD - width)  # the two halves may overlap
        later = value[step:] <= value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    return place


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            w = Words(part.column("text"))
            n = len(w.hash) - MIN_WORDS + 1
            if n <= 0:
                continue
            gram, key = span_grams(w, (GRAM, MIN_WORDS))
            at = np.flatnonzero(w.doc[:n] == w.doc[MIN_WORDS - 1 :])  # passages that lie in one text
            if not len(at):
                continue
            anchor = _least(gram)[at]
            first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
            offsets = (np.r_[first, len(at)] * 8).astype(np.int32)
            doc = w.doc[at[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[anchor[first]].view(np.int64)), pa.array(part.column("doc_id").to_numpy()[doc]), pa.array((at[first] - w.first[doc]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(key[at].tobytes())])],
                ["h", "doc_id", "start", "keys"],
            )


class Suffixes:
    """The suffixes of some records, in document order: ``key`` (hash of the first words), ``doc``, ``pos``, ``row`` (the record, whose gram is ``h``)."""

    def __init__(self, t: pa.Table):
        raw = t.column("keys").to_pylist()
        size = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
        self.row = np.repeat(np.arange(len(raw)), size)
        self.key = np.frombuffer(b"".join(raw), np.uint64)
        self.doc = t.column("doc_id").to_numpy()[self.row]
        self.pos = t.column("start").to_numpy()[self.row].astype(np.int64) + np.arange(len(self.row)) - np.repeat(np.cumsum(size) - size, size)
        self.h = t.column("h").to_numpy()
        if ((self.pos[1:] < self.pos[:-1]) & (self.doc[1:] == self.doc[:-1])).any():  # rows that repeat a doc_id
            order = np.lexsort((self.row, self.pos, self.doc))
            self.row, self.key, self.doc, self.pos = self.row[order], self.key[order], self.doc[order], self.pos[order]


class Levels:
    """Suffix arrays (keys in order, document and place of each) whose sizes are powers of two of a batch's."""

    def __init__(self) -> None:
        self.held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Scan a batch and take it up: which of its suffixes stand earlier, and the document where each stands first."""
        order = np.argsort(s.key, kind="stable")
        key = s.key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        array, first = key[new], order[new]  # the batch's suffix array: of equal suffixes the earliest
        doc, pos = s.doc[first], s.pos[first].astype(np.int32)
        fresh = np.ones(len(array), bool)
        for _, keys, docs, places in self.held:  # merge-scan: both are in order
            at = np.minimum(np.searchsorted(keys, array), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == array)
            doc[hit], pos[hit], fresh[hit] = docs[at[hit]], places[at[hit]], False
        run = np.cumsum(new) - 1
        earlier, source = np.empty(len(order), bool), np.empty(len(order), np.int64)
        earlier[order] = (s.doc[order] != doc[run]) | (s.pos[order] != pos[run])  # else it is the first, or a repeated row's
        source[order] = doc[run]
        size, keys, docs, places = 0, array[fresh], doc[fresh], pos[fresh]
        if not len(keys):
            return earlier, source
        while self.held and self.held[-1][0] == size:  # levels of equal size merge
            _, k, d, p = self.held.pop()
            keys, docs, places = np.concatenate([k, keys]), np.concatenate([d, docs]), np.concatenate([p, places])
            order = np.argsort(keys, kind="stable")  # two runs in order, which a stable sort merges
            keys, docs, places, size = keys[order], docs[order], places[order], size + 1
        self.held.append((size, keys, docs, places))
        return earlier, source


def _united(doc: np.ndarray, pos: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Passages of a document that meet, as one run, with the least source of all."""
    order = np.lexsort((pos, doc))
    doc, pos, source = doc[order], pos[order], source[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + MIN_WORDS)])
    last = np.r_[first[1:], len(doc)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(pos[first].astype(np.int32)), pa.array((pos[last] + MIN_WORDS).astype(np.int32)), pa.array(np.minimum.reduceat(source, first))], ["doc_id", "start_word", "end_word", "source_doc_id"])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Suffixes]]:
    """Of rows in order of (group, doc_id): a group, and about ``BATCH`` of its rows, all that it has of a document together."""
    held: list[pa.RecordBatch] = []
    now, last, n = None, None, 0
    for batch in batches:
        groups, docs = batch.column("group").to_numpy(), batch.column("doc_id").to_numpy()
        edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]).tolist() if len(groups) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if held and groups[a] == now and n >= BATCH:
                c = a + int(np.searchsorted(docs[a:b], last, "right"))
                held.append(batch.slice(a, c - a))
                if c == b:
                    continue
                a = c
            if held and (groups[a] != now or n >= BATCH):
                yield now, Suffixes(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(batch.slice(a, b - a))
            now, last, n = int(groups[a]), int(docs[b - 1]), n + b - a
    if held:
        yield now, Suffixes(pa.Table.from_batches(held))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in order of (part, doc_id, start), those of earlier batches first (group: twice the part, 1 more for new ones)."""
    part, levels = -1, Levels()
    for group, s in _batches(batches):
        if group >> 1 != part:
            part, levels = group >> 1, Levels()
        earlier, source = levels.add(s)
        if group & 1 and earlier.any():
            yield _united(s.doc[earlier], s.pos[earlier], source[earlier])


def _first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in the order of ``_index`` without the suffixes that stand earlier."""
    part, levels = -1, Levels()
    for group, s in _batches(batches):
        if group >> 1 != part:
            part, levels = group >> 1, Levels()
        at = np.flatnonzero(~levels.add(s)[0])
        if not len(at):
            continue
        first = np.flatnonzero(np.r_[True, (s.row[at][1:] != s.row[at][:-1]) | (at[1:] != at[:-1] + 1)])
        offsets = (np.r_[first, len(at)] * 8).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.h[s.row[at[first]]]), pa.array(s.doc[at[first]]), pa.array(s.pos[at[first]].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(s.key[at].tobytes())])],
            ["h", "doc_id", "start", "keys"],
        )


def records(docs: DataFrame) -> DataFrame:
    """(h, doc_id, start, keys): all passages of ``docs`` by their anchors."""
    return docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(_records, _RECORD)


def _together(rows: DataFrame, new: int) -> DataFrame:
    return rows.withColumn("group", F.col("h").bitwiseAND(PARTS - 1) * 2 + new)


def _meet(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("group", "doc_id", "start")


def _runs(found: DataFrame) -> DataFrame:
    by_start = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("start_word") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "run")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("source_doc_id").alias("source_doc_id"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id")
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, source_doc_id) of every run of words that stands earlier; see the module."""
    return _runs(_meet(_together(records(docs), 1)).mapInArrow(_index, _FOUND))


class Family:
    """Levels of records in ``folder`` (shared by all executors), to which batches of documents are added.

    The newest manifest names the levels; a batch that fails leaves it as it was. Adding batches one after the other finds
    what adding them at once does, where no document of a later batch has a smaller doc_id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def levels(self) -> list[tuple[int, str]]:
        """(size, name) of each level, the largest first."""
        number = newest(self.spark, self.folder, "manifest-")
        if number is None:
            return []
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/manifest-{number}").select("size", "name").collect()), reverse=True)

    def _write(self, rows: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_RECORD).parquet(f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """The repeated passages of ``docs``, which become part of the family."""
        before = self.levels()
        new = self._write(records(docs))
        rows = _together(self._read(new), 1)
        for _, name in before:
            rows = rows.unionByName(_together(self._read(name), 0))
        found = cut(_runs(_meet(rows).mapInArrow(_index, _FOUND)))
        held, size, gone = list(before), 0, []
        while held and held[-1][0] == size:  # levels of equal size merge: what stands in the older one leaves the newer
            old = held.pop()[1]
            both = _together(self._read(old), 0).unionByName(_together(self._read(new), 1))
            gone += [old, new]
            new, size = self._write(_meet(both).mapInArrow(_first_only, _RECORD)), size + 1
        number = newest(self.spark, self.folder, "manifest-")
        self.spark.createDataFrame([*held, (size, new)], "size int, name string").coalesce(1).write.parquet(f"{self.folder}/manifest-{0 if number is None else number + 1}")
        for name in gone:
            remove(self.spark, f"{self.folder}/{name}")
        return found


#: The same of DuckDB: each word of 50-word windows that stand earlier, and runs of such words.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, CAST(unnest(range(0, len(w) - 49)) AS INTEGER) AS pos, w FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS h FROM p),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM g
      WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)),
r AS (SELECT doc_id, pos, fd FROM f WHERE fd < doc_id OR (fd = doc_id AND fp < pos)),
n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, max(pos) + 50 - min(pos) AS n_words, min(fd) AS source_doc_id
FROM i GROUP BY doc_id, run
"""
