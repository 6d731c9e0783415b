"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets a leading space, spaces become U+2581, and no piece holds that sign but at its start: so texts fall into
words that are encoded apart. The distinct words that a task hasn't seen yet lie in one flat numpy array of symbols. In
each round a segmented minimum finds the best pair of each word; its leftmost occurrence merges, in all words at once
(all its occurrences, left to right, where no pair that the merged piece can form comes before it, so that the order
can't matter); then the arrays are compacted, and words without a pair leave. Rounds over a long word grow in number with
its length, and each is over all of it; so the pairs of a word of more than ``LONG`` characters wait in a queue instead,
whose time follows the length (times its logarithm). Symbols that are no piece become bytes. The model's tables are read
once by the driver, from the path given, and broadcast.

Defined results. A null text has null tokens and null round_trip, an empty one none and true. Rows of any doc_id, null or
repeated, are encoded each for itself. Texts are encoded whole, however long a word is. ``round_trip`` says whether
decoding gives the text again, which fails only for texts that hold U+2581 itself. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm._text import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Words that a task remembers; beyond it starts afresh.
REMEMBERED = 1 << 19
#: Characters of the longest word that goes through rounds.
LONG = 1 << 9


class Tables:
    """A model as arrays: characters to ids, pairs of ids to rank and merged id, ids to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = [i for i in range(self.size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)]
        pieces = {sp.id_to_piece(i): i for i in range(self.size)}
        normal = {p: i for p, i in pieces.items() if i not in set(special)}
        if any(sp.is_unused(i) for i in range(self.size)) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("only BPE models whose pieces hold white space at their start")
        if sp.encode("a bﬁ") != sp.encode("a b") + sp.encode("aﬁ")[1:]:
            raise ValueError("only models of identity normalisation")
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        score = {i: sp.get_score(i) for i in normal.values()}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for p, i in normal.items():
            pairs += [(normal[p[:k]], normal[p[k:]], ranks[score[i]], i) for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        left, right, rank, merged = (np.array(c, np.int64) for c in zip(*pairs))
        self.keys = left * self.size + right
        self.ranks, self.merged = rank.astype(np.int32), merged.astype(np.int32)
        #: the best rank of a pair that a piece takes part in; a rank is safe if its pieces come in none as good
        best = np.full(self.size, _NONE, np.int64)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        self.safe = np.ones(len(ranks), bool)
        self.safe[np.unique(rank[best[merged] <= rank])] = False
        self.byte_id = np.array([pieces.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)], np.int32)
        texts = [b""] * self.size
        for p, i in normal.items():
            texts[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            if sp.is_byte(int(self.byte_id[b])):
                texts[self.byte_id[b]] = bytes([b])
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        # characters of no longer piece stand alone; newline is worth cutting at
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in normal if len(p) > 1))
        inside = rf"[^{SPACE}{alone}]"
        self.word = rf"{SPACE}+{inside}*|{inside}+" + (f"|[{alone}]" if alone else "")
        # a mark that never follows a letter within a piece begins a word of its own
        for mark in ".,":
            if not any(re.search(rf"[^\W\d_]{re.escape(mark)}", p) for p in normal):
                self.word = rf"{SPACE}*[^\W\d_]+(?=[{re.escape(mark)}])|" + self.word

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (left < self.size) & (right < self.size)
        key = np.where(ok, left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out = self._rounds([w if len(w) <= LONG else "" for w in words])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._queue(w)
        return out

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id by left * (size + 0x110000) + right, where characters that are no piece fit in."""
        left, right = np.divmod(self.keys, self.size)
        return dict(zip((left * (self.size + 0x110000) + right).tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def _queue(self, word: str) -> bytes:
        """Ids of one word, whose pairs wait in a heap by rank and place."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, wide, pairs = len(code), self.size + 0x110000, self._pairs
        start = np.where(self.chars[code] >= 0, self.chars[code], self.size + code).astype(np.int32)
        rank, _ = self.rank_of(start[:-1], start[1:])
        key = np.where(rank == _NONE, -1, rank.astype(np.int64) * n + np.arange(n - 1))
        heap = np.sort(key[key >= 0]).tolist()
        sym, waits = array("i", start.tobytes()), array("q", np.r_[key, -1].tobytes())  # waits: the pair that begins here
        before, after = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        while heap:
            k = heappop(heap)
            at = k % n
            if waits[at] != k:
                continue
            gone = after[at]
            sym[at] = pairs[sym[at] * wide + sym[gone]][1]
            sym[gone] = waits[gone] = -1
            after[at] = end = after[gone]
            if end < n:
                before[end] = at
            for a, b in ((before[at], at), (at, end)):
                if a < 0:
                    continue
                found = pairs.get(sym[a] * wide + sym[b]) if b < n else None
                waits[a] = found[0] * n + a if found else -1
                if found:
                    heappush(heap, waits[a])
        ids = np.frombuffer(sym, np.int32)
        ids = ids[ids >= 0]
        return self._bytes(ids) if (ids >= self.size).any() else ids.astype("<i4").tobytes()

    def _rounds(self, words: list[str]) -> list[bytes]:
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        out = [b""] * len(words)
        word = np.flatnonzero(size)  # words at work, and their numbers of symbols
        size = size[word]
        sym = np.where(self.chars[code] >= 0, self.chars[code], self.size + code).astype(np.int32)
        rank, merged = np.full(len(sym), _NONE), np.full(len(sym), -1, np.int32)
        first = np.cumsum(size) - size
        if len(sym) > 1:
            rank[:-1], merged[:-1] = self.rank_of(sym[:-1], sym[1:])
            rank[first[1:] - 1] = _NONE
        while len(word):
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            if done.any():
                stay = np.repeat(~done, size)
                ready, ends = sym[~stay], np.cumsum(size[done])
                odd = np.maximum.reduceat(ready, ends - size[done]) >= self.size
                data, at = ready.astype("<i4").tobytes(), (ends * 4).tolist()
                for i, a, b, c in zip(word[done].tolist(), [0, *at], at, odd.tolist()):
                    out[i] = self._bytes(ready[a // 4 : b // 4]) if c else data[a:b]
                sym, rank, merged = sym[stay], rank[stay], merged[stay]
                word, size, low = word[~done], size[~done], low[~done]
                if not len(word):
                    break
                first = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(word)), size)
            hit = np.flatnonzero(rank == low[owner])
            new = np.r_[True, owner[hit][1:] != owner[hit][:-1]]
            # of hits that overlap every second; of a rank that isn't safe only a word's first
            run = np.r_[True, (hit[1:] != hit[:-1] + 1)] | new
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(place % 2 == 0) & (self.safe[low[owner[hit]]] | new)]
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            gone = np.bincount(owner[hit], minlength=len(word))
            moved = hit - np.arange(len(hit))
            sym, rank, merged = sym[keep], rank[keep], merged[keep]
            size = size - gone
            first = np.cumsum(size) - size
            last = np.zeros(len(sym), bool)
            last[first + size - 1] = True
            near = np.zeros(len(sym), bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            again = np.flatnonzero(near)
            rank[again], merged[again] = _NONE, -1
            again = again[~last[again]]
            rank[again], merged[again] = self.rank_of(sym[again], sym[again + 1])
        return out

    def _bytes(self, sym: np.ndarray) -> bytes:
        """Ids of symbols of which some are no piece."""
        ids: list[int] = []
        for s in sym.tolist():
            ids += [s] if s < self.size else self.byte_id[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(ids, "<i4").tobytes()

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each with its leading space, and where each begins (n + 1)."""
        n = self.off[ids + 1] - self.off[ids]
        ends = np.r_[0, np.cumsum(n)]
        at = np.arange(ends[-1]) + np.repeat(self.off[ids] - ends[:-1], n)
        return self.flat[at], ends[first]


def encode_texts(tables: Tables, texts: list[str | None], known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each begins (n + 1)."""
    find = re.compile(tables.word).findall
    split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    new = list({w for words in split for w in words if w not in known})
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list({w for words in split for w in words})
    known.update(zip(new, tables.encode_words(new)))
    parts = [b"".join(map(known.__getitem__, words)) for words in split]
    return np.frombuffer(b"".join(parts), "<i4"), np.r_[0, np.cumsum([len(p) // 4 for p in parts])].astype(np.int64)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = shared.value, {}
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, first = encode_texts(tables, texts, known)
                data, at = tables.decode(ids, first)
                data = data.tobytes()
                back = [None if t is None else t == data[at[i] + 1 : at[i + 1]].decode("utf-8", "replace") for i, t in enumerate(texts)]
                null = np.array([t is None for t in texts])
                tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.r_[null, False]), pa.array(ids))
                count = pa.array(np.diff(first).astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), count, tokens, pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            lists = batch.column("token_ids").to_pylist()
            first = np.r_[0, np.cumsum([len(x or ()) for x in lists])].astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            if ((ids < 0) | (ids >= tables.size)).any():
                raise ValueError("no such token id")
            data, at = tables.decode(ids, first)
            data = data.tobytes()
            texts = [None if x is None else data[at[i] + 1 : at[i + 1]].decode("utf-8", "replace") for i, x in enumerate(lists)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Tables(model))
    return docs.select("doc_id", "text").mapInArrow(_encode(shared), "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Tables(model))
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode(shared), "doc_id long, text string")
