"""Vectorised word kernel: a batch of texts becomes flat numpy arrays of word spans and 64-bit word hashes.

A word is a maximal run of letters and digits of the lower-cased text. Every byte from 0x80 on counts as part of a
letter, but for Latin-1 signs (U+0080-U+00BF), general punctuation (U+2000-U+207F) and CJK punctuation
(U+3000-U+303F), which separate. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _WORD[_lo:_hi] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, _U), "q": np.ones(1, _U)}
#: Bytes of text that one step of the kernel works on; a longer text is worked on alone and whole.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        base = np.full(max(n, 1 << 16), _P if name == "p" else _PINV, _U)
        base[0] = 1
        _powers[name] = np.cumprod(base)
    return _powers[name]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and ends (n + 1 offsets)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``mask``, and the text of each; a run ends where its text does."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return start, end, doc


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    for lead, seconds, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == lead)
        at = at[at + width <= len(data)]
        if len(at) and seconds:
            at = at[np.isin(data[at + 1], seconds)]
        for k in range(width):
            mask[at + k] = False
    return mask


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; the same bytes have the same hash wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_TABLE[data] * _power("p", n)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("q", n + 1)[start] + (end - start).astype(_U))


class Words:
    """Words of some texts: ``hash``, ``start``, ``end`` (bytes of ``data``), ``doc`` (index of text), ``first`` (n + 1: index of each text's first word)."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
        self.data, self.off = raw(texts)
        self.start, self.end, self.doc = spans(word_mask(self.data), self.off)
        self.hash = span_hash(self.data, self.start, self.end) if len(self.start) else np.zeros(0, _U)
        self.first = np.searchsorted(self.doc, np.arange(len(self.off)))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they all lie in its text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, _U), np.zeros(n, bool)
    out = np.zeros(n, _U)
    m = n - k + 1
    for j in range(k):
        out[:m] = out[:m] * _U(_P) + w.hash[j : j + m]
    ok = np.zeros(n, bool)
    ok[:m] = w.doc[:m] == w.doc[k - 1 :]
    return mix(out, 7), ok


def span_grams(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the k words from each word on, for each k of ``sizes``, whether or not they lie in one text; n - k + 1 of them."""
    n = len(w.hash)
    sums = np.zeros(n + 1, _U)
    np.cumsum(w.hash * _power("p", n)[:n], out=sums[1:])
    back = _power("q", n + 1)
    return [mix((sums[k:] - sums[: n + 1 - k]) * back[: n + 1 - k], k) for k in sizes]


def winnow(h: np.ndarray, ok: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of every ``window`` consecutive grams of one text; all of a text with fewer."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    n_ok = int(ok.sum())
    at = np.flatnonzero(ok)
    if not n_ok:
        return at
    v, d = h[at], doc[at]
    if window <= 1:
        return at
    m = n_ok - window + 1
    picked = np.zeros(n_ok, bool)
    if m > 0:
        best, arg = v[:m].copy(), np.zeros(m, np.int32)
        for j in range(1, window):
            less = v[j : j + m] <= best
            best[less] = v[j : j + m][less]
            arg[less] = j
        whole = d[:m] == d[window - 1 :]
        picked[(np.arange(m) + arg)[whole]] = True
    n_doc = np.bincount(d)
    short = (n_doc < window)[d]
    picked |= short
    return at[picked]
