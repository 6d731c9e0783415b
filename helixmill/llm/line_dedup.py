"""Line deduplication by a deletion-neighbourhood join.

A line is compared in its normal form: lower-cased, white space collapsed and trimmed. Lines of fewer than ``least_chars``
characters of it (by default ``LEAST_CHARS``: all that aren't empty count) are never duplicates, and of those of fewer than
``EDIT_CHARS`` only equal ones are: one edit makes another word of a short line. A longer line is a duplicate if an
earlier one (smaller doc_id, or the same and a smaller line number) has the same normal form or is one edit away: one
character inserted, deleted or replaced. ``kept_doc_id`` and ``kept_line`` are the earliest such line, whether or not that
is itself a duplicate of another.

Equal lines meet by hash: an aggregation, combined where lines are read, finds the earliest of each, so that a line that
stands in every document is no more work for one task than another; the numbers of lines that repeat then join it. Of the
distinct ones, two that are one edit apart share their first or their last half: the half of the shorter. So each line has
the hashes of either half, for the lengths it can be matched at, as keys. Lines that share a key go out under it with their
other part. Among these, each emits the hashes of all variants of its other part with one character deleted, and of the
part itself; equal variants join, and the two texts are then compared for their edit distance. Only lines that share half
their text make variants, and variants never leave their task.

Defined results. Null texts and rows of null doc_id have no lines here. Rows that repeat a doc_id with other texts are told
apart: of equal lines in them the earliest is that of the row of the smaller hash of its text, and
``without_duplicate_lines`` takes lines out of the row they stand in. Rows that repeat doc_id and text are one row:
``duplicate_lines`` counts their lines once, ``without_duplicate_lines`` keeps one of them. Empty texts have one empty line,
which is too short. Lines of any length are compared whole. Other columns, whatever their names, are carried along by
``without_duplicate_lines``, which removes duplicate lines from texts and drops the documents of which no line is left;
nulls and documents without duplicates stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._rows import text_hash, unused, without_repeats
from helixmill.llm._text import _PINV, _power, mix
from helixmill.session import cut

#: Characters of the shortest line that can be a duplicate, and of the shortest that one edit makes one: below, an edit is
#: more than a twelfth of the line, and "she is" is no "she it".
LEAST_CHARS, EDIT_CHARS = 1, 12


def normal(line: Column) -> Column:
    spaced = F.contains(line, F.lit("  "))
    for sign in "\t\r\f\x0b":
        spaced = spaced | F.contains(line, F.lit(sign))
    return F.lower(F.trim(F.when(spaced, F.regexp_replace(line, "[ \\t\\n\\r\\f\\x0B]+", " ")).otherwise(line)))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (n + 1)."""
    joined = "".join(texts.to_pylist())
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64), out=off[1:])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), off


def _variants(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the hash of it whole; and of it without each of its characters, with text and position."""
    value = mix(code.astype(np.uint64), 2) | np.uint64(1)
    n = len(code)
    power = _power("p", n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=total[1:])
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    back = _power("q", n + 1)
    size = np.diff(off).astype(np.uint64)
    whole = mix((total[off[1:]] - total[off[:-1]]) * back[off[:-1]] + size)
    at = np.arange(n)
    kept = (total[at] - total[off[:-1]][text]) + (total[off[1:]][text] - total[at + 1]) * np.uint64(_PINV)
    return whole, mix(kept * back[off[:-1]][text] + size[text] - np.uint64(1)), text, at - off[:-1][text]


def _one_edit(a: str, b: str) -> bool:
    """Whether the edit distance is 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if kept is not None and kept.num_rows:
            t = pa.concat_tables([kept, t])
        key = t.column("key").to_numpy()
        if not len(key):
            continue
        if key[0] == key[-1]:
            kept = t
            continue
        cutoff = int(np.searchsorted(key, key[-1]))
        kept = t.slice(cutoff)
        yield from _join(t.slice(0, cutoff))
    if kept is not None:
        yield from _join(kept)


def _join(t: pa.Table) -> Iterator[pa.RecordBatch]:
    key = t.column("key").to_numpy()
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    at = np.flatnonzero(np.repeat(size, size) > 1)
    if not len(at):
        return
    chars = np.cumsum(np.asarray(pc.utf8_length(t.column("rest").combine_chunks().take(pa.array(at))), dtype=np.int64))
    key = key[at]
    a = 0
    while a < len(at):  # whole groups, of about a million characters
        b = min(len(at), max(a + 1, int(np.searchsorted(chars, (chars[a - 1] if a else 0) + 1_000_000))))
        b = int(np.searchsorted(key, key[b - 1], "right"))
        yield from _join_groups(t.take(pa.array(at[a:b])))
        a = b


def _join_groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
    key, long = t.column("key").to_numpy().view(np.uint64), t.column("longer").to_numpy(zero_copy_only=False).astype(bool)
    doc, th, line = t.column("doc_id").to_numpy(), t.column("th").to_numpy(), t.column("line").to_numpy()
    rests = t.column("rest").combine_chunks()
    texts = rests.to_pylist()
    whole, cut, owner, pos = _variants(*_codes(rests))
    group = mix(key, 4)
    # replaced characters: equal length, the same position deleted; inserted ones: the shorter whole, the longer with one deleted
    one = ~long[owner]
    keys = np.concatenate([mix(cut[one] ^ group[owner[one]] ^ mix(pos[one].astype(np.uint64), 1)), mix(cut[~one] ^ mix(group[owner[~one]], 8)), mix(whole[~long] ^ mix(group[~long], 8))])
    who = np.concatenate([owner[one], owner[~one], np.flatnonzero(~long)])
    kind = np.concatenate([np.zeros(one.sum(), np.int8), np.full((~one).sum(), 2, np.int8), np.ones((~long).sum(), np.int8)])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    runs = np.flatnonzero(np.r_[new, True])
    multi = np.flatnonzero(np.diff(runs) > 1)
    found: dict[tuple[int, int, int], tuple[int, int, int]] = {}

    def note(i: int, j: int) -> None:
        """Of lines i and j, the later is a duplicate of the earlier."""
        x, y = (int(doc[i]), int(th[i]), int(line[i])), (int(doc[j]), int(th[j]), int(line[j]))
        if x == y or not _one_edit(texts[i], texts[j]):
            return
        if x < y:
            x, y = y, x
        if y < found.get(x, x):
            found[x] = y

    for r in multi:
        run = order[runs[r] : runs[r + 1]]
        members, kinds = who[run], kind[run]
        if kinds[0] == 0:
            first = min(members, key=lambda i: (doc[i], th[i], line[i]))
            for i in members:
                note(int(i), int(first))
        else:
            shorter, longer = members[kinds == 1], np.unique(members[kinds == 2])
            if len(shorter) and len(longer):
                first = min(longer, key=lambda i: (doc[i], th[i], line[i]))
                for i in shorter:
                    note(int(i), int(first))
                    for j in longer:
                        note(int(i), int(j))
    if found:
        rows = [(*x, *y) for x, y in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()) * 2)], ["doc_id", "th", "line", "near_doc_id", "near_th", "near_line"])


_ID = ("doc_id", "th", "line")


def _duplicates(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, th, line, kept) of every duplicate line; th is the hash of its row's text, kept (doc_id, th, line)."""
    lines = (
        docs.select("doc_id", "text")
        .filter("doc_id is not null and text is not null")
        .select("doc_id", text_hash().alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
        .select(*_ID, normal(F.col("raw")).alias("s"))
        .filter(F.length("s") >= max(1, least_chars))
        .withColumns({"h": F.xxhash64("s"), "g": F.xxhash64(F.lit("again"), "s")})
    )
    # the one exchange that holds text, of each line once for each task that reads it; all that follows reads it again, or
    # moves hashes and numbers (k > 0 in each branch, so that the exchange is the same)
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct(*_ID, "s")).alias("f"), F.count(F.lit(1)).alias("k"))
    often = cut(firsts.filter("k > 1 and octet_length(f.s) > 0").select("h", "g", F.struct(*(f"f.{c}" for c in _ID)).alias("first")))
    twins = lines.select("h", "g", F.struct(*_ID).alias("id")).join(often, ["h", "g"]).filter("id <> first").select("id", "first").distinct()
    distinct = firsts.filter("k > 0").select("h", "g", *(f"f.{c}" for c in (*_ID, "s"))).filter(F.length("s") >= EDIT_CHARS)
    n = F.length("s")

    def keyed(longer: bool, back: bool, with_rest: bool) -> Column:
        size = (n - int(longer)).cast("int")  # of the shorter of the two lines to be compared
        half = F.floor(size / 2).cast("int")
        same_part, rest = (F.right("s", half), F.substr("s", F.lit(1), n - half)) if back else (F.left("s", half), F.substr("s", half + 1))
        parts = [F.xxhash64(F.lit(back), size, same_part).alias("key"), F.lit(longer).alias("longer")]
        return F.struct(*parts, *[rest.alias("rest")] * with_rest)

    def under(rows: DataFrame, with_rest: bool) -> DataFrame:
        keys = F.array(*(keyed(x, y, with_rest) for x in (False, True) for y in (False, True)))
        return rows.select(*(c for c in rows.columns if c != "s"), F.explode(keys).alias("e")).select("*", "e.*").drop("e")

    # keys under which two distinct lines stand, one of them as the shorter or equal; and the lines that have such a key
    by_key = Window.partitionBy("key")
    shared = (
        under(distinct.select("h", "g", "s"), False)
        .withColumns({"n": F.count(F.lit(1)).over(by_key), "short": F.min("longer").over(by_key)})
        .filter("n > 1 and not short")
        .groupBy("h", "g")
        .agg(F.collect_set("key").alias("keys"))
    )
    near = (
        under(distinct.join(shared.hint("shuffle_hash"), ["h", "g"]).select(*_ID, "s", "keys"), True)
        .filter(F.array_contains("keys", F.col("key")))
        .select(*_ID, "key", "longer", "rest")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_neighbours, "doc_id long, th long, line int, near_doc_id long, near_th long, near_line int")
    )
    near = near.groupBy(F.struct(*_ID).alias("id")).agg(F.min(F.struct(F.col("near_doc_id").alias("doc_id"), F.col("near_th").alias("th"), F.col("near_line").alias("line"))).alias("near"))
    through = twins.join(near.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("near", "first").alias("kept"))
    return through.union(near.select("id", F.col("near").alias("kept"))).select("id.*", "kept")


def duplicate_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line, kept_doc_id, kept_line) of every duplicate line of ``least_chars`` or more; lines count from 0."""
    return _duplicates(docs, least_chars).select("doc_id", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"))


def without_duplicate_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the duplicate lines taken out of text (and n_chars, if there is one, counted again)."""
    docs = without_repeats(docs)
    d, h, gone, kept = unused(docs, "d", "h", "gone", "kept")
    dropped = _duplicates(docs, least_chars).groupBy(F.col("doc_id").alias(d), F.col("th").alias(h)).agg(F.collect_set("line").alias(gone))
    out = docs.join(dropped, (F.col("doc_id") == F.col(d)) & (text_hash() == F.col(h)), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    out = out.withColumn(kept, F.when(F.col(gone).isNotNull() & F.col("text").isNotNull(), left)).filter(F.col(kept).isNull() | (F.size(kept) > 0))
    text = F.array_join(kept, "\n")
    columns = {"text": F.when(F.col(kept).isNull(), F.col("text")).otherwise(text)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


#: The same in DuckDB: lines one edit apart share a half, and a deletion variant of one position or of the longer.
ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
num AS (SELECT doc_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS line, a FROM raw),
l AS (SELECT doc_id, line, lower(trim(regexp_replace(a[line + 1], '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS s FROM num),
f AS (SELECT s, length(s) AS n, min(struct_pack(doc_id := doc_id, line := line)) AS id FROM l WHERE length(s) >= 1 GROUP BY s),
w AS (SELECT * FROM f WHERE n >= 12),
c AS (SELECT a.s AS x, b.s AS y, a.id AS i, b.id AS j FROM w a JOIN w b ON b.n = a.n AND a.s < b.s AND left(a.s, a.n // 2) = left(b.s, a.n // 2)
      UNION SELECT a.s, b.s, a.id, b.id FROM w a JOIN w b ON b.n = a.n AND a.s < b.s AND right(a.s, a.n // 2) = right(b.s, a.n // 2)
      UNION SELECT a.s, b.s, a.id, b.id FROM w a JOIN w b ON b.n = a.n + 1 AND left(a.s, a.n // 2) = left(b.s, a.n // 2)
      UNION SELECT a.s, b.s, a.id, b.id FROM w a JOIN w b ON b.n = a.n + 1 AND right(a.s, a.n // 2) = right(b.s, a.n // 2)),
v AS (SELECT i, j FROM (SELECT *, unnest(range(1, length(y) + 1)) AS p FROM c)
      WHERE (length(x) = length(y) AND left(x, p - 1) || substr(x, p + 1) = left(y, p - 1) || substr(y, p + 1))
         OR (length(x) < length(y) AND x = left(y, p - 1) || substr(y, p + 1))),
e AS (SELECT greatest(i, j) AS late, min(least(i, j)) AS near FROM v GROUP BY 1),
o AS (SELECT l.doc_id, l.line, struct_pack(doc_id := l.doc_id, line := l.line) AS id, f.id AS first_id, e.near
      FROM l JOIN f ON f.s = l.s LEFT JOIN e ON e.late = f.id)
SELECT doc_id, line, coalesce(near, first_id).doc_id AS kept_doc_id, coalesce(near, first_id).line AS kept_line
FROM o WHERE id <> first_id OR near IS NOT NULL
"""
