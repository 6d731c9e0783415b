"""SimHash near-duplicates by bit-sliced comparison.

Each document gets a 256-bit SimHash of its distinct lower-cased words, weighted by their length (long words say more
than "of" and "the"). Documents of equal fingerprint collapse to one. Candidates share some sampled bits in one of many
tables. The number of bits grows with the logarithm of the number of documents, so that about ``BUCKET`` unrelated ones
share a table with one, and the number of tables follows from the bits: as many as it takes for a pair ``radius`` bits apart
to be found with a chance of ``RECALL``. A bucket's fingerprints stand vertically as bit planes, 64 to a machine word, and
each is compared with 64 others at a time: exclusive-or with a plane, added into carry-save bitwise counters, a block being
abandoned once all its lanes exceed ``radius``. Buckets send spanning forests only, so a group of n copies costs n edges.
Groups are the connected components of pairs within the radius.

Defined results. A null or wordless text is in no group, nor is a row of null doc_id. Every row is a document of its own,
also where a doc_id repeats: rows of one doc_id with unlike texts are in groups of their own, those that repeat doc_id and
text are copies of each other, and ``without_near_duplicates`` keeps one. The first of a group is that of the least doc_id,
then of the least hash of its text. Very long texts are hashed whole. Other columns, whatever their names, are ignored, or
kept by ``without_near_duplicates``. An empty table has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._rows import text_hash, without_repeats, without_rows
from helixmill.llm._text import Words, chunks, mix
from helixmill.session import cut

BITS = 256
#: Bits that may differ: one word in eight or so. Unrelated texts of one language differ in about 107 of 256 (sd 8).
RADIUS = 50
#: Chance that a pair at the radius shares a table, at least; fingerprints of unrelated texts in a bucket, about; share of
#: the bits in which such texts agree.
RECALL, BUCKET, AGREE = 0.91, 512, 0.58
#: Bits of a table at least: with fewer, pairs well within the radius would be found hardly more often than those at it.
LEAST_BITS = 12
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of a fingerprint and a block that are compared at once.
STEP = 1 << 16


@lru_cache
def tables(radius: int, n: int) -> np.ndarray:
    """Positions of the bits that each table samples for ``n`` fingerprints."""
    bits = max(LEAST_BITS, math.ceil(math.log(max(n, BUCKET) / BUCKET) / -math.log(AGREE)))
    share = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    many = 1 if share >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - share))
    return np.stack([np.random.Generator(np.random.PCG64(77 + t)).choice(BITS, bits, replace=False) for t in range(many)])


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n x 32 bytes, and the number of distinct words of each text."""
    w = Words(texts)
    n = len(texts)
    out, count = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, np.int64)
    if not len(w.hash):
        return out, count
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d, weight = h[new], d[new], np.clip((w.end - w.start)[order][new] - 1, 1, 11).astype(np.float32)
    first = np.searchsorted(d, np.arange(n + 1))
    for i in range(n):
        a, b = first[i], first[i + 1]
        count[i] = b - a
        total = np.zeros(BITS, np.float32)
        for c in range(a, b, 8192):
            e = min(b, c + 8192)
            bits = np.stack([mix(h[c:e], 11 + s) for s in range(BITS // 64)], axis=1).view(np.uint8)
            total += weight[c:e] @ np.unpackbits(bits, axis=1).astype(np.float32)
        if b > a:
            out[i] = np.packbits(2 * total > weight[a:b].sum(dtype=np.float64))
    return out, count


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            fp, count = fingerprints(part.column("text"))
            keep = np.flatnonzero(count > 0)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("h").take(at), pa.array([fp[i].tobytes() for i in keep], pa.binary())], ["doc_id", "h", "fp"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _band_batches(radius: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = tables(radius, n)
        power = (1 << np.arange(positions.shape[1], dtype=np.int64)).astype(np.float64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                bits = np.unpackbits(_matrix(part.column("fp")), axis=1).astype(np.float64)
                for t, at in enumerate(positions):
                    key = (bits[:, at] @ power).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key * len(positions) + t), part.column("rep"), part.column("fp")], ["key", "rep", "fp"])

    return run


def close_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of ``fp`` at most ``radius`` bits apart with lo[i] <= j < hi[i]; bit-sliced."""
    n = len(fp)
    blocks = (n + 63) // 64
    bits = np.zeros((blocks * 64, fp.shape[1] * 8), np.uint8)
    bits[:n] = np.unpackbits(fp, axis=1)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    flip = (np.zeros(1, np.uint64) - bits[:n].T.astype(np.uint64)) & _ONES
    width = radius.bit_length()
    lo = np.maximum(lo, np.arange(n) + 1)
    many = np.where(hi > lo, (np.maximum(hi, 1) - 1) // 64 - lo // 64 + 1, 0)
    ends = np.cumsum(many)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        for q, blk in _combos(a, b, lo, many):
            base = blk * 64
            left, right = np.clip(lo[q] - base, 0, 64), np.clip(hi[q] - base, 0, 64)
            lanes = _below(right) & ~_below(left)
            over = np.zeros(len(q), np.uint64)
            count = [np.zeros(len(q), np.uint64) for _ in range(width)]
            alive = np.arange(len(q))
            for p0 in range(0, planes.shape[0], 3):
                carry_in = [planes[p][blk] ^ flip[p][q] for p in range(p0, min(p0 + 3, planes.shape[0]))]
                while len(carry_in) < 3:
                    carry_in.append(np.zeros(len(q), np.uint64))
                x, y, z = carry_in
                u = x ^ y
                one, two = u ^ z, (x & y) | (u & z)  # carry-save: three planes become a sum and a carry
                c = count[0] & one
                count[0] = count[0] ^ one
                if width > 1:
                    u = count[1] ^ two
                    nxt = (count[1] & two) | (u & c)
                    count[1] = u ^ c
                    c = nxt
                    for k in range(2, width):
                        c, count[k] = count[k] & c, count[k] ^ c
                    over |= c
                else:
                    over |= c | two
                if p0 % 24 == 21:
                    gone = over | _above(count, radius)
                    stay = (lanes & ~gone) != 0
                    if not stay.all():  # blocks of which all lanes exceed the radius are abandoned
                        q, blk, lanes, over, alive = q[stay], blk[stay], lanes[stay], over[stay], alive[stay]
                        count = [x[stay] for x in count]
                        if not len(q):
                            break
            if not len(q):
                continue
            hit = lanes & ~(over | _above(count, radius))
            some = np.flatnonzero(hit)
            if len(some):
                lane = np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(lane)
                yield q[some][r], blk[some][r] * 64 + c
        a = b


def _combos(a: int, b: int, lo: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    total = int(many[a:b].sum())
    if not total:
        return
    if b == a + 1:
        for s in range(0, total, STEP):
            blk = lo[a] // 64 + np.arange(s, min(total, s + STEP))
            yield np.full(len(blk), a), blk
        return
    q = np.repeat(np.arange(a, b), many[a:b])
    yield q, lo[q] // 64 + np.arange(total) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, 0 <= n <= 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, _ONES, (np.uint64(1) << np.minimum(n, 63)) - np.uint64(1))


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes of which the bit-sliced counter exceeds ``radius``."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _ONES)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
    """Lower the labels of both ends of each pair to the smaller until nothing changes."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum(label, label[label], out=label)
        if (before == label).all():
            return


def _buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if held and held[-1].column("key")[0].as_py() == key[-1]:
                held.append(batch)
                continue
            cutoff = int(np.searchsorted(key, key[-1]))
            yield from _compare(pa.Table.from_batches([*held, batch.slice(0, cutoff)]), radius)
            held = [batch.slice(cutoff)]
        if held:
            yield from _compare(pa.Table.from_batches(held), radius)

    return run


def _compare(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    key = t.column("key").to_numpy()
    n = len(key)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    at = np.flatnonzero(size > 1)
    if not len(at):
        return
    t = t.take(pa.array(at))
    key, fp, rep = key[at], _matrix(t.column("fp").combine_chunks()), t.column("rep").to_numpy()
    lo, hi = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
    # lanes of one bucket in order of rep, so that the smallest label is the smallest rep
    order = np.lexsort((rep, key))
    fp, rep = fp[order], rep[order]
    label = np.arange(len(rep))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0
    for i, j in close_pairs(fp, lo, hi, radius):
        held.append((i, j))
        pending += len(i)
        if pending > 1 << 21:
            _forest(*(np.concatenate(x) for x in zip(*held)), label)
            held, pending = [], 0
    if held:
        _forest(*(np.concatenate(x) for x in zip(*held)), label)
    moved = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.stack([rep[moved], rep[label[moved]]], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the component of each end of ``edges`` (a, b); labels fall to the least neighbour's and then to their own label's."""
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = cut(lower.join(up, "root").select("id", "old", F.least("root", "top").alias("root")))
        labels = new.select("id", "root")
        if new.filter("root < old").isEmpty():
            return labels


def _groups(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, h, group_id, kept): h is the hash of the row's text."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", text_hash().alias("h"), "text")
    prints = cut(rows.mapInArrow(_hash_batches, "doc_id long, h long, fp binary").withColumn("row", F.monotonically_increasing_id()))
    reps = prints.groupBy("fp").agg(F.min("row").alias("rep"))
    bands = reps.select("rep", "fp").mapInArrow(_band_batches(radius, prints.count()), "key long, rep long, fp binary")
    edges = bands.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(radius), "a long, b long")
    same = prints.join(reps, "fp").filter("row > rep").select(F.col("row").alias("a"), F.col("rep").alias("b"))
    members = components(edges.union(same)).join(prints.select("row", "doc_id", "h"), F.col("id") == F.col("row"))
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "h", "row")).alias("first"))
    return members.join(first, "root").select("doc_id", "h", F.col("first.doc_id").alias("group_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, kept): every document of a group of two or more; the one of least doc_id is its group_id and is kept."""
    return _groups(docs, radius).drop("h")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group; rows of null doc_id or text stay."""
    docs = without_repeats(docs)
    return without_rows(docs, _groups(docs, radius).filter("not kept"))
