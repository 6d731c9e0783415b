"""Toxicity by noisy-channel deobfuscation.

Terms: from at most ``MAX_LABELLED`` labelled rows (the first by a hash of doc_id) come the words and word beginnings
that toxic rows hold far more often than others, each with its log odds; a beginning counts where a word goes on after
it, in different ways. The least score that sets toxic rows apart best becomes the threshold.

Language model: counts of all three-character sequences of all documents, interpolated.

Decoding: a stretch of text that may be written for a term, that is one whose signs (digits and symbols taken for the
letters they resemble, marks left out, repetitions once) begin as the term's do, becomes a lattice of what each
character may stand for: itself, a letter it resembles, nothing if it repeats the one before or stands between letters.
A stretch begins at any word or bit of one and may run on across blanks and marks. Viterbi's algorithm finds the likeliest reading under the
language model, with a price for each deviation, and the reading is searched for terms. What can't be read as a term
can't change the score, so nothing else is decoded. The score is the sum of the terms' weights over the distinct words
they are found in, less for long texts (half at ``HALF_WORDS`` words); a text of more than ``WINDOW`` words has the score
of the best ``WINDOW`` words in a row, wherever they begin, if that is more.

Defined results. A null or empty text has score 0 and isn't rejected. Rows of null doc_id, and repeated ones, are judged
each for itself. Texts are read whole. Without labels, or with labels that no term explains, nothing is rejected. Labels
of null doc_id or toxic, or without a document, teach nothing; documents of equal text teach once, and so do near copies
(SimHash) of which all are toxic or all are clean. Other columns are ignored, or kept by ``without_toxic``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._text import _P, Words, chunks, raw, spans
from helixmill.llm.simhash import RADIUS, _forest, close_pairs, fingerprints
from helixmill.session import cut

MAX_LABELLED = 20_000
#: A term's shortest beginning, and the longest that is told from the whole word; whole words may be of any length.
SHORT, LONG = 4, 9
#: Chance that any of the words and beginnings that are tested passes for a term though toxic rows hold it no more than
#: others: with so many tested, it says how large the log likelihood ratio of a term must be.
SIGNIFICANCE = 1e-4
#: Contexts (pairs of words around it) that a term must stand in: this share of the toxic rows, within these bounds; and the
#: share of a term's rows that may be clean.
CONTEXTS, FEWEST, MOST, MOST_CLEAN = 0.05, 3, 5, 0.5
#: Words for which the sum of weights counts half: a long text holds more of what only looks like a term.
HALF_WORDS = 2000
#: Words in a row that are judged by themselves within a longer text, so that what is toxic stays so among clean text.
WINDOW = 500
#: Prices of reading a sign as a letter, of a mark or space between letters that is left out or taken for the end of a
#: word, of a digit among letters that is a digit, of a letter left out that repeats the one before: in a pair, which
#: words have too, or among three or more.
LEET, DROP, BLANK, DIGIT, PAIR, REPEAT = 1.0, 0.5, 2.5, 2.5, 4.5, 0.5
#: Price of leaving out a blank beside two letters or more, which is the end of a word at no price.
JOIN = 3.0
#: Single letters that a stretch goes on for at most beyond what may be a term.
MORE_LETTERS = 32
RESEMBLES = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
#: Letters of other scripts that look like Latin ones.
RESEMBLES |= dict(zip("аеорсухіѕјԁһӏαοειντκρυ", "aeopcyxisjdhlaoeivtkpu"))

_SKELETON = np.zeros(256, np.uint8)
for _b in range(97, 123):
    _SKELETON[_b] = _b
for _sign, _letters in RESEMBLES.items():
    if ord(_sign) < 128:
        _SKELETON[ord(_sign)] = ord(_letters[0])
_SKELETON[ord("l")] = ord("i")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, np.int64)
for _b in range(97, 123):
    _SYMBOL[_b] = _b - 96
for _b in range(48, 58):
    _SYMBOL[_b] = 27
for _b in range(128, 256):
    _SYMBOL[_b] = 28 + (_b * 37 >> 2) % 36
_SYMBOLS = 64


@lru_cache
def _beyond_ascii() -> np.ndarray:
    """Of each code point: 0 for a mark, 1 for a letter, else the letter that the sign resembles."""
    out = np.array([chr(c).isalpha() for c in range(0x110000)]).astype(np.uint8)
    for sign, letters in RESEMBLES.items():
        out[ord(sign)] = _SKELETON[ord(letters[0])]
    return out


def _signs(data: np.ndarray) -> np.ndarray:
    """What each byte is in a skeleton; 0 for what is left out."""
    sign = _SKELETON[data]
    if len(data) and data.max() >= 128:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        far = np.flatnonzero(code >= 128)
        kind, at, after = _beyond_ascii()[code[far]], lead[far], np.r_[lead, len(data)][far + 1]
        for k in range(4):
            some = (kind == 1) & (at + k < after)
            sign[at[some] + k] = data[at[some] + k]
        sign[at[kind > 1]] = kind[kind > 1]
    return sign


def _skeleton(text: str) -> bytes:
    s = _signs(np.frombuffer(text.lower().encode(), np.uint8))
    s = s[s > 0]
    return s[np.r_[True, s[1:] != s[:-1]]].tobytes() if len(s) else b""


def _flat(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if c != word[i - 1 : i])


# --- language model ---


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            data, off = raw(pc.utf8_lower(part.column("text")))
            s = np.zeros(len(data) + 2 * len(off), np.int64)  # two blanks between texts
            s[np.arange(len(data)) + np.repeat(2 * np.arange(1, len(off)), np.diff(off))] = _SYMBOL[data]
            if len(s) > 2:
                total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])


class LanguageModel:
    """log P(symbol | two before), interpolated from counts of three, two and one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        c = np.zeros(_SYMBOLS**3)
        c[codes] = counts
        c = c.reshape((_SYMBOLS,) * 3)
        two, one = c.sum(0), c.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * _SYMBOLS)
        p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
        self.log = np.log((c + 4 * p2[None]) / (c.sum(2, keepdims=True) + 4)).astype(np.float32)

    def step(self, context: tuple[int, int], text: str) -> tuple[float, tuple[int, int]]:
        a, b = context
        score = 0.0
        for byte in text.encode():
            s = int(_SYMBOL[byte])
            score += float(self.log[a, b, s])
            a, b = b, s
        return score, (a, b)


def language_model(docs: DataFrame) -> LanguageModel:
    counts = docs.select("text").filter("text is not null").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return LanguageModel(counts.column("code").to_numpy(), counts.column("n").to_numpy())


def decode(text: str, model: LanguageModel) -> str:
    """The likeliest reading of a stretch, in lower case; blanks stand where words end."""
    text = text.lower()
    # state: model context and the last character read, with what was read before it; best score and reading
    states: dict[tuple[tuple[int, int], str], tuple[float, str]] = {((0, 0), ""): (0.0, "")}
    for i, c in enumerate(text):
        letter = c.isalpha()
        reads: list[tuple[str, float]] = []
        if letter or c.isdigit():
            reads.append((c, 0.0 if letter or not (text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha()) else DIGIT))
        else:
            inner = text[:i].strip(" ") and text[i + 1 :].strip(" ")
            apart = inner and c.isspace() and any(sum(map(str.isalnum, bit)) > 1 for bit in (*text[:i].split()[-1:], *text[i:].split()[:1]))
            reads.append((" ", BLANK if inner and not apart else 0.0))
            if inner:
                reads.append(("", JOIN if apart else DROP))
        reads += [(x, LEET) for x in RESEMBLES.get(c, "")]
        pair = c != text[i - 2 : i - 1] and c != text[i + 1 : i + 2]
        new: dict[tuple[tuple[int, int], str], tuple[float, str]] = {}
        for (context, last), (score, read) in states.items():
            for x, price in reads:
                if x == "" or (x == " " and last in (" ", "")):
                    key, got = (context, last), (score - price, read)
                else:
                    gain, after = model.step(context, x)
                    key, got = (after, x), (score + gain - price, read + x)
                if key not in new or got[0] > new[key][0]:
                    new[key] = got
                if x == last and x not in ("", " "):
                    key, got = (context, last), (score - price - (PAIR if pair else REPEAT), read)
                    if key not in new or got[0] > new[key][0]:
                        new[key] = got
        states = new
    best = max(((score + model.step(context, " ")[0], read) for (context, _), (score, read) in states.items()), default=(0.0, ""))
    return best[1]


# --- terms ---


def _words(text: str) -> list[str]:
    w = Words(pa.array([text]))
    data = w.data.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(w.start, w.end)]


def _beginnings(word: str) -> list[str]:
    """Beginnings that the word goes beyond, and the whole with a full stop."""
    return [word[:n] for n in range(SHORT, min(len(word) - 1, LONG) + 1)] + [word + "."]


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean groups of near copies of each beginning; the rows of a group follow each other."""
    counts: dict[str, list[int]] = {}
    group, seen = None, set()

    def out() -> pa.RecordBatch:
        terms = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[t][0] for t in terms], pa.int64()), pa.array([counts[t][1] for t in terms], pa.int64())], ["term", "bad", "good"])

    for batch in batches:
        for toxic, text, of in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
            terms = {p for w in set(_words(text)) for p in _beginnings(w)}
            group, seen = of, seen if of == group else set()
            for p in terms - seen:
                counts.setdefault(p, [0, 0])[0 if toxic else 1] += 1
            seen |= terms
            if len(counts) > 200_000:
                yield out()
                counts.clear()
    yield out()


def _contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct pairs of words between which some beginnings stand in toxic rows."""
        wanted: set[str] = shared.value
        found: set[tuple[str, str]] = set()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                if toxic:
                    words = _words(text)
                    found.update((p, f"{before} {after}") for before, w, after in zip(["", *words], words, [*words[1:], ""]) for p in _beginnings(w) if p in wanted)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["term", "around"])

    return run


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            fp, count = fingerprints(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("toxic"), pa.array([f.tobytes() if n else None for f, n in zip(fp, count)], pa.binary())], ["h", "toxic", "fp"])


def _copies(rows: DataFrame) -> dict[int, int]:
    """By the hash of its text, the group of each row that is a near copy of another of its class; at most ``max_labelled`` fingerprints come to the driver."""
    prints = rows.mapInArrow(_prints, "h long, toxic int, fp binary").filter("fp is not null").orderBy("h").toArrow()
    out: dict[int, int] = {}
    for toxic in (0, 1):
        own = prints.filter(pc.equal(prints.column("toxic"), toxic))
        n = own.num_rows
        if n < 2:
            continue
        fp, h = np.frombuffer(b"".join(own.column("fp").to_pylist()), np.uint8).reshape(n, -1), own.column("h").to_numpy()
        label = np.arange(n)
        for i, j in close_pairs(fp, np.zeros(n, np.int64), np.full(n, n), RADIUS):
            _forest(i, j, label)
        out |= {int(h[i]): int(h[label[i]]) for i in np.flatnonzero(label != np.arange(n))}
    return out


def learn_terms(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], DataFrame]:
    """Terms with their weights, and the labelled rows (toxic, text) they come from."""
    chosen = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select("toxic", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).repartition(64, "h")
    rows = cut(rows.groupBy("h", "g").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"), F.min("text").alias("text")).select("toxic", "text", "h"))
    total = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return {}, rows
    copies = _copies(rows)
    moved = docs.sparkSession.createDataFrame(list(copies.items()), "h long, copies long")
    grouped = rows.join(F.broadcast(moved), "h", "left").select("toxic", "text", F.coalesce("copies", "h").alias("copies"))
    grouped = cut(grouped.repartition(64, "copies").sortWithinPartitions("copies"))
    total = {bool(r[0]): r[1] for r in grouped.groupBy("toxic").agg(F.count_distinct("copies")).collect()}
    n1, n0 = total[True], total[False]
    counted = grouped.mapInArrow(_teach, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    least = min(MOST, max(FEWEST, round(CONTEXTS * n1)))
    tested = counted.filter(F.col("bad") >= least).toArrow().to_pylist()
    least_g2 = _critical(SIGNIFICANCE / max(len(tested), 1))
    clean_enough = lambda bad, good: good <= bad * MOST_CLEAN / (1 - MOST_CLEAN)
    likely = [(r["term"], r["bad"], r["good"]) for r in tested if clean_enough(r["bad"], r["good"]) and _g2(r["bad"], r["good"], n1, n0) >= least_g2]
    wanted = docs.sparkSession.sparkContext.broadcast({t for t, _, _ in likely})
    around = rows.mapInArrow(_contexts(wanted), "term string, around string").distinct().groupBy("term").count()
    contexts = {r[0]: r[1] for r in around.collect()}
    # a term that always stands between the same words has no more evidence than these; copies take none away
    varied = [(t, min(bad, contexts.get(t, 0)), good) for t, bad, good in likely if contexts.get(t, 0) >= least]
    return choose_terms([x for x in varied if clean_enough(*x[1:])], n1, n0, least_g2), rows


def _g2(bad: int, good: int, n1: int, n0: int) -> float:
    """Log likelihood ratio of a term's rows against the share of toxic rows."""
    base = n1 / (n1 + n0)
    return 2 * (bad * math.log(bad / (bad + good) / base) + (good * math.log(good / (bad + good) / (1 - base)) if good else 0))


def _critical(chance: float) -> float:
    """The value that a chi-square variable of one degree of freedom exceeds with this chance."""
    low, high = 0.0, 2000.0
    while high - low > 1e-6:
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > chance else (low, middle)
    return high


def choose_terms(counts: list[tuple[str, int, int]], n1: int, n0: int, least_g2: float) -> dict[str, float]:
    """Of terms (text, toxic rows, clean rows) the most telling ones, none of which begins another."""
    kept = {term: (bad, good) for term, bad, good in counts if bad and _g2(bad, good, n1, n0) >= least_g2}
    out: dict[str, float] = {}
    within: set[str] = set()  # beginnings of chosen terms
    for term in sorted(kept, key=lambda t: (-_g2(*kept[t], n1, n0), -len(t), t)):
        text = term.rstrip(".")
        if term not in within and not any(text[:n] in out for n in range(SHORT, len(text))):
            bad, good = kept[term]
            out[term] = round(math.log((bad + 0.5) / (n1 + 1)) - math.log((good + 0.5) / (n0 + 1)), 6)
            within.update(text[:n] for n in range(SHORT, len(text)))
    return {t: w for t, w in sorted(out.items()) if w > 0}


# --- scoring ---


class Scorer:
    def __init__(self, terms: dict[str, float], model: LanguageModel | None, threshold: float = math.inf):
        self.terms, self.model, self.threshold = terms, model, threshold
        self.texts = sorted({t.rstrip(".") for t in terms})
        self.exact = {t: t for t in terms}
        self.flat = {_flat(t): t for t in sorted(terms) if len(t.rstrip(".")) >= SHORT}
        self._plain = self._table([t.encode() for t in self.texts])
        self._bones = self._table(sorted({s for t in self.texts if len(s := _skeleton(t)) >= 3}))
        self._open = {_skeleton(t) for t in terms if not t.endswith(".")}

    @staticmethod
    def _table(keys: list[bytes]) -> dict[int, np.ndarray]:
        """Sorted hashes of keys by length."""
        out: dict[int, list[int]] = defaultdict(list)
        for k in keys:
            out[len(k)].append(_rolling(k))
        return {n: np.array(sorted(v), np.uint64) for n, v in out.items()}

    def of_words(self, words: list[str], flat: bool = False) -> set[tuple[str, str]]:
        """Terms that stand in some words, with the word; flat: with every letter once, as decoding can't always tell "ss" from "s", but for short words, of which too little is left."""
        by = self.flat if flat else self.exact
        found = {(w + ".", w) for w in words if w + "." in self.exact} if flat else set()
        for w in map(_flat, words) if flat else words:
            found |= {(t, w) for t in (by.get(w + "."), *(by.get(w[:n]) for n in range(SHORT - flat, len(w)))) if t}
        return found

    def judge(self, texts: pa.Array) -> tuple[list[set[tuple[str, str]]], list[float]]:
        """Terms of each text with the words they stand in, and its score."""
        w = Words(texts)
        found = self.find(w)
        return [{(t, x) for _, t, x in f} for f in found], [self.score(f, int(n)) for f, n in zip(found, np.diff(w.first))]

    def score(self, found: list[tuple[int, str, str]], n_words: int) -> float:
        """Of (place in words, term, word): the whole text's score, or its best window's."""
        pairs = {(t, x) for _, t, x in found}
        best = sum(self.terms[t] for t, _ in sorted(pairs)) / (1 + n_words / HALF_WORDS)
        if n_words > WINDOW and found:
            found = sorted(found)
            held: dict[tuple[str, str], int] = defaultdict(int)
            total, first = 0.0, 0
            for place, term, word in found:
                while found[first][0] <= place - WINDOW:
                    pair = found[first][1:]
                    held[pair] -= 1
                    total -= self.terms[pair[0]] * (not held[pair])
                    first += 1
                total += self.terms[term] * (not held[term, word])
                held[term, word] += 1
                best = max(best, total / (1 + WINDOW / HALF_WORDS))
        return round(best, 6)

    def find(self, w: Words) -> list[list[tuple[int, str, str]]]:
        """(place in words, term, word) of each term in each text, plain and decoded."""
        found: list[list[tuple[int, str, str]]] = [[] for _ in range(len(w.off) - 1)]
        if not self.terms:
            return found
        if len(w.start):
            for i in _begin(w.data, w.start, w.end, self._plain)[0]:
                found[w.doc[i]] += [(int(i), *x) for x in self.of_words([w.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")])]
        if self.model is not None and len(w.data):
            for doc, at, stretch in self._stretches(w.data, w.off):
                plain = _words(stretch)
                if not self.of_words(plain):
                    found[doc] += [(int(np.searchsorted(w.start, at)), *x) for x in self.of_words(_words(decode(stretch, self.model)), flat=True)]
        return found

    def _stretches(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(text, place in bytes, stretch) of all that may be written for a term."""
        start, end, doc = spans(~_BLANK[data], off)
        if not len(start):
            return
        sign = _signs(data)
        at = np.flatnonzero(sign)
        if not len(at):
            return
        chunk = np.searchsorted(start, at, "right") - 1
        letters = np.bincount(chunk[(data[at] & 0xC0) != 0x80], minlength=len(start))
        # chunks at which a row of single letters, with marks among them, has ended
        barrier = np.append(np.flatnonzero((letters > 1) | np.r_[True, doc[1:] != doc[:-1]]), len(start))
        new = np.r_[True, (sign[at][1:] != sign[at][:-1]) | (doc[chunk][1:] != doc[chunk][:-1])]
        run = np.cumsum(new) - 1
        bone, of = sign[at][new], doc[chunk][new]
        begin = np.flatnonzero(new)
        # a term may begin at any sign that stands after none
        head = np.flatnonzero((at == start[chunk]) | (sign[np.maximum(at - 1, 0)] == 0))
        stop = np.searchsorted(of, of[run[head]], "right")
        hit, size = _begin(bone, run[head], stop, self._bones)
        for i, n in zip(hit, size):
            first = head[i]
            k = int(chunk[max(first, begin[run[first] + n - 1])])
            if letters[k] < 2:
                k = min(int(barrier[np.searchsorted(barrier, k, "right")]) - 1, k + MORE_LETTERS)
            stretch = data[at[first] : end[k]].tobytes()
            if k + 1 < len(start) and doc[k + 1] == doc[k] and _skeleton(stretch.decode("utf-8", "replace")) in self._open:
                stretch = data[at[first] : end[k + 1]].tobytes()
            yield int(doc[k]), int(at[first]), stretch.decode("utf-8", "replace")


def _rolling(key: bytes) -> int:
    h = 0
    for i, b in enumerate(key):
        h += (b + 1) * pow(_P, i, 1 << 64)
    return h % (1 << 64)


def _begin(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of data[start:end] may begin with a key (by a hash of its first bytes), and the size of the longest such key."""
    hit = np.zeros(len(start), np.int64)
    h, done = np.zeros(len(start), np.uint64), 0
    live = np.arange(len(start))
    for n in sorted(table):
        live = live[(end - start)[live] >= n]
        if not len(live):
            break
        for i in range(done, n):
            h[live] += (data[start[live] + i].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(_P, i, 1 << 64))
        done = n
        at = np.minimum(np.searchsorted(table[n], h[live]), len(table[n]) - 1)
        hit[live[table[n][at] == h[live]]] = n
    some = np.flatnonzero(hit)
    return some, hit[some]


def _label_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(s.judge(part.column("text"))[1], pa.float64())], ["toxic", "score"])

    return run


def best_threshold(scores: list[tuple[int, float]]) -> float:
    """Half way below the score from which on calling rows toxic has the best F1."""
    total = sum(t for t, _ in scores)
    best, threshold = 0.0, math.inf
    ranked = sorted((s, t) for t, s in scores if s > 0)[::-1]
    hits = 0
    for i, (s, t) in enumerate(ranked):
        hits += t
        following = ranked[i + 1][0] if i + 1 < len(ranked) else 0.0
        if following == s:
            continue
        f1 = 2 * hits / (i + 1 + total)
        if f1 > best:
            best, threshold = f1, (s + following) / 2
    return threshold


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Scorer:
    spark = docs.sparkSession
    terms, rows = learn_terms(docs, labels, max_labelled)
    if not terms:
        return Scorer({}, None)
    scores = rows.mapInArrow(_label_scores(spark.sparkContext.broadcast(Scorer(terms, None))), "toxic int, score double").toArrow()
    return Scorer(terms, language_model(docs), best_threshold(list(zip(scores.column("toxic").to_pylist(), scores.column("score").to_pylist()))))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                found, scores = s.judge(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([len({t for t, _ in f}) for f in found], pa.int32()), pa.array([",".join(sorted({t for t, _ in f})) for f in found], pa.string()), pa.array([x >= s.threshold for x in scores], pa.bool_())],
                    ["doc_id", "score", "n_terms", "terms", "rejected"],
                )

    return run


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, n_terms, terms, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    return docs.select("doc_id", "text").mapInArrow(_judge(shared), "doc_id long, score double, n_terms int, terms string, rejected boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rows that are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                keep = np.array(s.judge(part.column("text"))[1]) < s.threshold
                if keep.any():
                    yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
