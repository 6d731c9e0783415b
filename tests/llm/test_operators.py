"""The ten operators against brute force, exact round trips, or held-out accuracy."""

from __future__ import annotations

import html
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, html_consensus, line_dedup, pii, queries, simhash, sp_bpe, suffix_index, topk, toxicity, url_filter
from helixmill.llm._text import Words, grams, winnow
from helixmill.session import table
from tests.conftest import SF
from tests.oracle import assert_equal

WORD = re.compile(r"[0-9a-zÀ-῿₀-⿿぀-\U0010ffff]+")
DOCS = "doc_id long, text string"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name])


# --- kernel ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab C.é—«日 \n0", max_size=40)), min_size=1, max_size=6))
def test_words_equal_regex(texts):
    w = Words(pa.array(texts, pa.string()))
    data = w.data.tobytes()
    got = [[data[a:b].decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] for i in range(len(texts))]
    lower = pa.compute.utf8_lower(pa.array(texts, pa.string()).fill_null("")).to_pylist()
    assert got == [WORD.findall(t) for t in lower]
    spelled = {}
    for h, x in zip(w.hash.tolist(), (x for g in got for x in g)):
        assert spelled.setdefault(x, h) == h
    assert len(set(spelled.values())) == len(spelled)


def test_winnow_guarantee():
    rng = random.Random(3)
    for _ in range(30):
        shared = [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(13)]
        texts = [" ".join([str(rng.random())[2:8] for _ in range(rng.randint(0, 30))] + shared + [str(rng.random())[2:8] for _ in range(rng.randint(0, 30))]) for _ in range(2)]
        w = Words(pa.array(texts))
        h, ok = grams(w, 6)
        at = winnow(h, ok, w.doc, 8)
        assert set(h[at[w.doc[at] == 0]].tolist()) & set(h[at[w.doc[at] == 1]].tolist())


# --- SimHash ---


@pytest.mark.parametrize("radius", [1, 3, 20, 44, 50, 63])
def test_bit_slicing_equals_counting(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 256, (330, 32), dtype=np.uint8)
    for i in range(0, 330, 3):
        fp[i + 1] = fp[i]
        fp[i + 1, : rng.integers(1, 9)] ^= rng.integers(0, 256, dtype=np.uint8)
    lo = np.repeat(np.arange(0, 330, 110), 110)
    got = {(a, b) for i, j in simhash.close_pairs(fp, lo, lo + 110, radius) for a, b in zip(i.tolist(), j.tolist())}
    far = np.unpackbits(fp[:, None] ^ fp[None], axis=2).sum(2)
    assert got == {(i, j) for i in range(330) for j in range(i + 1, 330) if lo[i] == lo[j] and far[i, j] <= radius}


def test_simhash_recall_and_groups(spark):
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    fp, _ = simhash.fingerprints(pa.array([d.text for d in docs]))
    group = {r.doc_id: r.group_id for r in simhash.near_duplicates(table(spark, SF, "documents")).collect()}
    bits = fp.view(np.uint64)
    pairs = [(docs[i].doc_id, docs[j].doc_id) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(1) <= simhash.RADIUS) + i + 1]
    found = sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.95 * len(pairs)
    # nothing that brute force would not join
    root = {d.doc_id: d.doc_id for d in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(d) == top(g) for d, g in group.items())


@pytest.mark.parametrize(("radius", "size"), [(10, 3000), (35, 3000), (44, 250_000), (simhash.RADIUS, 3000), (simhash.RADIUS, 250_000), (simhash.RADIUS, 10**7)])
def test_isolated_pairs_are_found_at_any_distance(radius, size):
    rng = np.random.default_rng(radius)
    for far in sorted({1, radius // 2, radius - 5, radius}):
        n = 1500 if size < 10**6 else 300
        fp = rng.integers(0, 2, (n, simhash.BITS), dtype=np.uint8)
        twin = fp.copy()
        for row in twin:
            row[rng.choice(simhash.BITS, far, replace=False)] ^= 1
        both = pa.array([x.tobytes() for x in np.packbits(np.concatenate([fp, twin]), axis=1)], pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n)), both], ["rep", "fp"])
        t = pa.Table.from_batches(simhash._band_batches(radius, size)([batch])).sort_by("key")
        pairs = {(min(r.values()), max(r.values())) for b in simhash._buckets(radius)(t.to_batches()) for r in b.to_pylist()}
        assert len(pairs & {(i, i + n) for i in range(n)}) >= (0.9 if far == radius else 0.93 if far > radius - 6 else 0.99) * n


def test_buckets_stay_small_as_documents_grow():
    """Bits follow the number of documents, tables the bits; a bucket holds about as many unrelated ones at any size, tables grow less than as the root."""
    sizes = [10**k for k in range(5, 11)]
    found = [simhash.tables(simhash.RADIUS, n).shape for n in sizes]
    assert [x for _, x in found] == sorted(x for _, x in found) and [x for x, _ in found] == sorted(x for x, _ in found)
    assert all(n * simhash.AGREE**bits <= simhash.BUCKET * 4 for n, (_, bits) in zip(sizes, found)) and all(many <= n**0.4 for n, (many, _) in zip(sizes, found))


def test_simhash_planted(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    rows, twins = [], {}
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(k % 3):
            copy = [w if rng.random() > 0.05 else rng.choice(vocabulary) for w in base]
            twins[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).filter("not kept").collect()}
    assert got <= set(twins) and len(got) >= 0.95 * len(twins)  # one word in twenty differs


# --- lines ---


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _line_duplicates(rows):
    lines = [(d, k, " ".join(x.split()).lower()) for d, t in rows if d is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted((d, k, s) for d, k, s in lines if s)
    out = set()
    for i, (d, k, s) in enumerate(lines):
        near = [(e, m) for e, m, t in lines[:i] if s == t or (min(len(s), len(t)) >= 12 and abs(len(s) - len(t)) < 2 and _distance(s, t) <= 1)]
        if near:
            out.add((d, k, *min(near)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["the quick brown fox jumps over it", "a line that has thirty one letters", "éàü ñandú çedilla straße und mehr", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "twelve chars", "eleven char"]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "a"])
            lines.append("".join(s) if rng.random() < 0.8 else "short")
        rows.append((d, "\n".join(lines)))
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == _line_duplicates(rows)


def test_short_lines_that_are_equal(spark):
    long = "a line that has thirty one letters"
    rows = [(1, f"Share\n\n{long}\nyes"), (2, "  SHARE \n\n" + long[:-1] + "\nyet"), (3, "share\nYes\nshares\n" + long)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {tuple(r) for r in line_dedup.duplicate_lines(df).collect()}
    assert got == {(2, 0, 1, 0), (3, 0, 1, 0), (3, 1, 1, 3), (2, 2, 1, 2), (3, 3, 1, 2)} == _line_duplicates(rows)
    assert {tuple(r) for r in line_dedup.duplicate_lines(df, 24).collect()} == {(2, 2, 1, 2), (3, 3, 1, 2)}
    assert {tuple(r) for r in line_dedup.without_duplicate_lines(df).collect()} == {rows[0], (2, "\nyet"), (3, "shares")}


def test_lines_are_cut_out(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(1, f"{line}\nown", 37), (2, f"first\n{line.upper()}\nlast", 1), (3, line[:-1], 1), (4, None, None)], DOCS + ", n_chars long")
    assert {tuple(r) for r in line_dedup.without_duplicate_lines(df).collect()} == {(1, f"{line}\nown", 37), (2, "first\nlast", 10), (4, None, None)}


# --- passages ---


def _passages(rows):
    size = suffix_index.MIN_WORDS
    ws = sorted((d, words(t)) for d, t in rows if d is not None and t is not None)
    first: dict = {}
    for d, w in ws:
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    out = set()
    for d, w in ws:
        runs: list[list[int]] = []
        for i in range(len(w) - size + 1):
            e, j = first[tuple(w[i : i + size])]
            if (e, j) < (d, i):
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + size
                    runs[-1][2] = min(runs[-1][2], e)
                else:
                    runs.append([i, i + size, e])
        out |= {(d, a, b, b - a, s) for a, b, s in runs}
    return out


def _passage_rows(seed=2):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefg") + str(rng.randint(0, 99)) for _ in range(n)) for n in (49, 50, 51, 70, 200)]
    rows = []
    for d in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared)
            if rng.random() < 0.3:
                w = s.split()
                w[rng.randrange(len(w))] = "edited"
                s = " ".join(w)
            parts += [s if rng.random() < 0.6 else " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(1, 80)))]
        rows.append((d, ". ".join(parts)))
    return rows + [(100, "la " * 300), (101, "la " * 120)]


def test_passages_equal_brute_force(spark):
    rows = _passage_rows()
    got = {tuple(r) for r in suffix_index.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert got == _passages(rows)


@pytest.mark.parametrize("batch", [1, 7, 64, 10_000])
def test_levels(monkeypatch, batch):
    """Small batches make many levels that merge."""
    monkeypatch.setattr(suffix_index, "BATCH", batch)
    rows = _passage_rows(7)
    t = pa.Table.from_batches(suffix_index._records([pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})]))
    t = t.append_column("group", pa.array((t.column("h").to_numpy() & 3) * 2 + 1)).sort_by([("group", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
    sizes = []
    real = suffix_index.Levels.add
    monkeypatch.setattr(suffix_index.Levels, "add", lambda self, s: (real(self, s), sizes.append([x[0] for x in self.held]))[0])
    found = pa.Table.from_batches(suffix_index._index(b for b in t.to_batches(max_chunksize=5)))
    covered = {(r["doc_id"], i) for r in found.to_pylist() for i in range(r["start_word"], r["end_word"])}
    assert covered == {(d, i) for d, a, b, _, _ in _passages(rows) for i in range(a, b)}
    assert all(x == sorted(set(x), reverse=True) for x in sizes) and (batch > 10 or max(map(max, filter(None, sizes))) > 1)


def test_batches_of_a_family_equal_one(spark, tmp_path):
    rows = _passage_rows(9)
    family, got = suffix_index.Family(spark, str(tmp_path / "family")), set()
    for a, b in ((0, 20), (20, 21), (21, 40), (40, 60), (60, 60)):
        got |= {tuple(r) for r in family.add(spark.createDataFrame(rows[a:b], DOCS).repartition(2)).collect()}
    assert got == _passages(rows) and [k for k, _ in family.levels()] == [2, 0]
    assert {p.name for p in (tmp_path / "family").iterdir() if p.name.startswith("level-")} == {n for _, n in family.levels()}
    assert family.add(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_are_compared_by_whole_words(spark):
    """Texts that share 49 words and then words whose hashes agree in 16 bits share no passage."""
    made = [f"w{i}" for i in range(3000)]
    w = Words(pa.array([" ".join(made)]))
    alike: dict = {}
    for x, h in zip(made, w.hash.tolist()):
        alike.setdefault(h >> 48, []).append(x)
    pairs = [v[:2] for v in alike.values() if len(v) > 1][:20]
    assert len(pairs) == 20
    rows = []
    for k, (x, y) in enumerate(pairs):
        shared = [f"p{k}x{i}" for i in range(49)]
        rows += [(4 * k, " ".join([*shared, x])), (4 * k + 1, " ".join([*shared, y])), (4 * k + 2, " ".join([x, *shared])), (4 * k + 3, " ".join([y, *shared]))]
    assert suffix_index.repeated_passages(spark.createDataFrame(rows, DOCS)).count() == 0


# --- personal data ---


def test_checks():
    def luhn(digits):
        return sum(d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19)))
        assert pii.luhn(s) == (luhn(s) and len(set(s)) > 1)
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and pii.iban("DE89370400440532013000") and not pii.iban("DE89370400440532013001") and not pii.iban("GB82WEST")
    assert pii.ipv4("1.2.3.4") and not pii.ipv4("256.1.1.1") and not pii.ipv4("01.2.3.4")
    assert pii.ssn("123-45-6789") and not pii.ssn("666-45-6789") and not pii.ssn("123-00-6789")


def test_pii_spans(spark):
    text = "Mail jo.doe@mail.example.com or call +1 (017) 555-7713. Card 4111 1111 1111 1111, order 4111 1111 1111 1112; IBAN DE89 3704 0044 0532 0130 00 from 10.1.2.3. The manual, which came out later than all of these, is version 1.2.3.4 of 2024-01-02. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    got = [(text[a:b], k) for a, b, k, _ in pii.find(text)]
    assert got == [("jo.doe@mail.example.com", "EMAIL"), ("+1 (017) 555-7713", "PHONE"), ("4111 1111 1111 1111", "CREDIT_CARD"), ("DE89 3704 0044 0532 0130 00", "IBAN"), ("10.1.2.3", "IPV4"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "SECRET")]
    assert pii.find("sha1 04dbebab91ab85687d33eeaaf9ac699e1188f962 commit") == []
    assert [k for *_, k, _ in pii.find("ring 0171 555 77 13 please")] == [] and [k for *_, k, _ in pii.find("phone 0171 555 77 13 please")] == ["PHONE"]
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "nothing", None)], DOCS + ", kind string")
    assert pii.redact(df).filter("doc_id = 1").first().text.startswith("Mail [EMAIL] or call [PHONE]. Card [CREDIT_CARD], order 4111")
    assert pii.redact(df).columns == df.columns and pii.redact(df).filter("text is null").count() == 1


def test_groups_that_run_on():
    card, es, pl = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874"
    for text, want in {
        f"{card} 12/27": [card], f"{card.replace(' ', '')} 123 cvv": [card.replace(" ", "")], f"{card.replace(' ', '-')}-12": [card.replace(" ", "-")], f"no 12 {card}": [card], f"{card} 5500 0000 0000 0004 12": [card, "5500 0000 0000 0004"],
        f"{es} is": [es], f"to {es} from us": [es], f"{pl} and {es} or": [pl, es], f"{es.replace(' ', '')} is": [es.replace(" ", "")], f"AB12 {es} is": [es], "4111 1111 1111 1112 12": [],
    }.items():
        assert [text[a:b] for a, b, k, _ in pii.find(text) if k in ("CREDIT_CARD", "IBAN")] == want, text


def test_pii_query_is_the_same_as_by_row(spark):
    docs = table(spark, SF, "documents").collect()
    want = Counter((d.doc_id, k, a, b, s) for d in docs for a, b, k, s in pii.find(d.text))
    assert Counter(tuple(r) for r in queries.QUERIES["op4_pii"](spark, SF).collect()) == want and len(want) > 20


def _emails_by_hand(text):
    """Addresses around each "@", without patterns: (start, end)."""
    word = lambda c: c.isalnum() or c == "_"
    out = []
    for at in (i for i, c in enumerate(text) if c == "@"):
        a = at
        while a and (word(text[a - 1]) or text[a - 1] in ".+%-"):
            a -= 1
        b = at + 1
        while b < len(text) and (word(text[b]) or text[b] in "-."):
            b += 1
        host = text[at + 1 : b]
        while host:  # the longest host of good labels that ends in letters, where no word goes on
            labels = host.split(".")
            good = len(labels) > 1 and all(x and x[0].isalnum() and x[-1].isalnum() for x in labels) and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24
            after = text[at + 1 + len(host) : at + 2 + len(host)]
            if good and not (after and (word(after) or after == "-")):
                break
            host = host[:-1]
        user = text[a:at]
        if user and host and len(user) <= 64 and ".." not in user + host:
            out.append((a, at + 1 + len(host)))
    return out


def _cards_by_hand(text):
    """Card numbers by their digits: from each digit at which a number can begin, the longest that passes the sum."""
    word = lambda c: c.isalnum() or c == "_"

    def passes(digits):
        total = 0
        for i, d in enumerate(reversed([int(x) for x in digits])):
            total += sum(divmod(2 * d, 10)) if i % 2 else d
        return total % 10 == 0 and len(set(digits)) > 1

    out, i = [], 0
    while i < len(text):
        if text[i] not in "0123456789" or (i and (word(text[i - 1]) or text[i - 1] in ".+-")):
            i += 1
            continue
        ends, digits, j = [], "", i
        while j < len(text) and len(digits) < 19:
            if text[j] in "0123456789":
                digits += text[j]
                j += 1
            elif text[j] in " -" and j + 1 < len(text) and text[j + 1] in "0123456789":
                j += 1
            else:
                break
            if text[j - 1] in "0123456789" and 13 <= len(digits):
                ends.append((j, digits))
        free = lambda e: not (e < len(text) and (word(text[e]) or text[e] == "-" or (text[e] == "." and text[e + 1 : e + 2].isdigit())))
        whole = [(e, d) for e, d in ends if free(e)]
        hit = None
        if whole:
            top = whole[-1][0]
            hit = next((e for e, d in reversed(ends) if e <= top and (e == top or text[e] in " -") and passes(d)), None)
        if hit:
            out.append((i, hit))
        i = hit or i + 1
    return out


def test_emails_and_cards_equal_a_search_by_hand(spark):
    docs = {d.doc_id: d.text for d in table(spark, SF, "documents").collect() if d.text}
    got: dict = {}
    for r in queries.QUERIES["op4_pii"](spark, SF).collect():
        got.setdefault((r.doc_id, r.kind), []).append((r.start_char, r.end_char))
    near = lambda t, a, b, ws: any(re.sub(r"[\W_]+", " ", f" {x} ").lower().find(f" {w} ") >= 0 for x in (t[max(0, a - 40) : a], t[b : b + 40]) for w in ws)
    n = 0
    for d, t in docs.items():
        assert sorted(got.get((d, "EMAIL"), [])) == _emails_by_hand(t), d
        cards = [(a, b) for a, b in _cards_by_hand(t) if not near(t, a, b, ("isbn", "order", "tracking", "serial", "invoice", "imei")) or near(t, a, b, ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "tarjeta"))]
        assert sorted(got.get((d, "CREDIT_CARD"), [])) == cards, d
        n += len(cards) + len(got.get((d, "EMAIL"), []))
    assert n > 20


# --- decontamination ---


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_contaminated_equals_brute_force(spark, most):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abc") + str(rng.randint(0, 30)) for _ in range(rng.randint(10, 40)))) for i in range(12)]
    rows = []
    for d in range(80):
        w = [str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item))
        piece = item[a : a + rng.randint(5, 40)]
        at = rng.randint(0, len(w))
        rows.append((d, " ".join(w[:at] + piece + w[at:])))
    want = set()
    for d, t in rows:
        for i, u in items:
            x, y = words(t), words(u)
            best = None
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= decontaminate.MIN_SPAN and (best is None or (-n, p, q) < best):
                        best = (-n, p, q)
            if best:
                want.add((d, i, -best[0], best[1], best[2]))
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), most)
    assert {tuple(r) for r in got.collect()} == want and want


# --- HTML ---


def _page(body):
    return f"<!doctype html><html><head><title>t</title><script>var x='</p><div>';</script></head><body>{body}</body></html>"


def test_html_consensus(spark):
    long, ad = "Text of the page goes on and on, as texts do. " * 5, "Buy now, a long and winding advertisement. " * 4
    usual = [(i, f"http://a.example/{i}", _page(f"<nav><a href=x>{ad * 3}</a></nav><div class='post-{i} main'><p>{long}{i}<p>More &amp; more</div><div class=ad>{ad}</div>")) for i in range(4)]
    odd = (9, "http://user@A.example:80/9", _page(f"<div class='main post-9'><p>Short.</p></div><div class=ad>{ad}</div>"))
    other = (10, "https://b.example", _page(f"<article><ul><li>{long}<li>two</ul><footer>{ad}</footer></article>"))
    rows = [*usual, odd, other, (11, None, _page(f"<main>{long}</main>")), (12, "x", None), (13, "//c.example", ""), (None, "http://a.example/", "<div")]
    for most in (html_consensus.MAX_BROADCAST_BYTES, 0):
        got = {r.page_id: r for r in html_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most).collect()}
        assert got[9].path == "html>body>div.main.post-#" and got[9].text == "Short." and got[9].host == "a.example"
        assert got[0].text == " ".join(f"{long}0".split()) + "\nMore & more"
        assert got[10].text == " ".join(long.split()) + "\ntwo" and got[11].path == "html>body>main" and got[11].host is None
        assert (got[12].path, got[12].text) == (None, None) and (got[13].path, got[13].text) == (None, "") and got[None].text == ""


def test_votes_equal_counting(spark):
    pages = table(spark, SF, "pages")
    votes: dict = {}
    for p in pages.collect():
        page = html_consensus.Page(p.html)
        i = page.best()
        host = re.match(r"https?://([^/?#:]+)", p.url)[1]
        if i >= 0:
            v = votes.setdefault(host, {}).setdefault(page.path(i), [0, 0.0])
            v[0] += 1
            v[1] += page.scores[i]
    want = {h: min(v, key=lambda k: (-v[k][0], -v[k][1], k)) for h, v in votes.items()}
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    assert {r.host: r.path for r in html_consensus.winning_paths(pages.select("html", host.alias("host"))).collect()} == want


class _Tree(HTMLParser):
    """An independent reading by the standard library's parser, as a tree of [tag, step, parent, children]."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.root = self.at = ["", "", None, []]
        self.raw = None
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        h = html_consensus
        if self.raw:
            return
        if tag in ("noscript", "template", "svg", "iframe", "textarea", "select"):
            self.raw = tag
            return
        while True:  # what the tag closes
            x = self.at
            while x[0] and x[0] not in h._CLOSES.get(tag, ()) and x[0] not in h._FENCES:
                x = x[2]
            if not x[0] or x[0] not in h._CLOSES.get(tag, ()):
                break
            self.at = x[2]
            if tag != "tr":
                break
        names = sorted({re.sub("[0-9]+", "#", c) for c in (dict(attrs).get("class") or "").split()})
        node = [tag, ".".join([tag, *names]), self.at, []]
        self.at[3].append(node)
        if tag not in h._VOID:
            self.at = node

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        x = self.at
        while x[0] and x[0] != tag:
            x = x[2]
        if x[0]:
            self.at = x[2]

    def handle_data(self, data):
        if not self.raw and self.at[0] not in ("script", "style"):
            self.at[3].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def containers(self):
        """(path, score, node) in document order."""
        found = []

        def walk(node, path, around, links, aside):
            texts = "".join(c if isinstance(c, str) else "\0" for c in node[3]).split("\0")
            for s in texts:
                if s.strip() and around and not aside:
                    n = -len(s) if links else len(s)
                    found[around[-1]][1] += n
                    if len(around) > 1:
                        found[around[-2]][1] += n / 2
            for c in node[3]:
                if not isinstance(c, str):
                    inner, below = [*path, c[1]], around
                    if c[0] in html_consensus._CONTAINERS:
                        below = [*around, len(found)]
                        found.append([">".join(inner), 0.0, c])
                    walk(c, inner, below, links or c[0] == "a", aside or c[0] in html_consensus._ASIDE)

        walk(self.root, [], [], False, False)
        return found

    @staticmethod
    def text(nodes):
        out, done = [], set()

        def walk(node):
            done.add(id(node))
            for c in node[3]:
                if isinstance(c, str):
                    out.append(c)
                elif c[0] not in ("script", "style"):
                    block = c[0] in html_consensus._BLOCKS
                    out.append("\n" * block)
                    if c[0] not in html_consensus._ASIDE:
                        walk(c)
                    out.append("\n" * block)

        for node in nodes:
            if id(node) not in done:
                walk(node)
            out.append("\n")
        lines = (" ".join(x.split()) for x in html.unescape("".join(re.sub(r"\s+", " ", x) if x.strip("\n") else x for x in out)).split("\n"))
        return "\n".join(x for x in lines if x)


def test_html_equals_another_parser(spark):
    """Votes and texts of all pages by a reading that shares nothing but the lists of tags."""
    pages = table(spark, SF, "pages").collect()
    trees = {p.page_id: _Tree(p.html) for p in pages if p.html is not None}
    host = {p.page_id: m[1].lower() if p.url and (m := re.match(r"https?://([^/?#:]+)", p.url)) else None for p in pages}
    votes: dict = {}
    best = {}
    for i, tree in trees.items():
        boxes = tree.containers()
        top = max(boxes, key=lambda b: b[1], default=None)
        if top and top[1] > 0:
            best[i] = top
            v = votes.setdefault(host[i], {}).setdefault(top[0], [0, 0.0])
            v[0] += 1
            v[1] += top[1]
    winner = {h: min(v, key=lambda k: (-v[k][0], -v[k][1], k)) for h, v in votes.items()}
    want = {}
    for i, tree in trees.items():
        chosen = [b for b in tree.containers() if b[0] == winner.get(host[i])] or [best[i]] * (i in best)
        want[i] = (chosen[0][0] if chosen else None, tree.text([b[2] for b in chosen]))
    got = {r.page_id: (r.path, r.text) for r in queries.QUERIES["op6_html_consensus"](spark, SF).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "x", '<a "' * 250_000, "<p><div>" + "<span>" * 80_000 + "<h1>" * 120_000, "<div>" * 100_000 + "</span>" * 70_000, "<!-" * 300_000, "<table>" + "<tr><td><b>" * 90_000, """<a "<b '<c '""" * 80_000 + ">"])
def test_long_pages_take_time_in_proportion(source):
    began = time.process_time()
    page = html_consensus.Page(source)
    if (i := page.best()) >= 0:
        assert page.of_path(page.path(i)) == [i]
    assert time.process_time() - began < 10  # a second or three; a page that is read again for each tag takes hours


# --- URLs ---


def test_urls(spark):
    cases = {"http://xxx.example": (1, 0, True), "http://essex.example/sextant": (0, 0, False), "http://free.example/bets": (0, 2, True), "http://free.example/free/freedom": (0, 1, False), "http://a/c%61sino": (1, 0, True), "http://a/CASINO1": (1, 0, True), "": (0, 0, False), None: (0, 0, False), "ports": (0, 0, False)}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    assert [(r.n_strict, r.n_soft, r.rejected) for r in url_filter.judge(df).orderBy("page_id").collect()] == list(cases.values())
    assert url_filter.judge(df, {}).filter("rejected").count() == 0


def test_url_weights_and_tables(spark, tmp_path):
    rows = [("Spam", "strict", None), ("deal", "soft", 0.5), ("win", "soft", 1.5), ("win", "soft", 1.0), ("x9", "soft", 2.0), (None, "soft", 1.0), ("odd", "other", 9.0)]
    spark.createDataFrame(rows, "term string, kind string, weight double").write.parquet(str(tmp_path / "v"))
    terms = url_filter.vocabulary(spark, str(tmp_path / "v"))
    assert terms == {"spam": float("inf"), "deal": 0.5, "win": 1.5, "x9": 2.0}
    (tmp_path / "v.csv").write_text("term,kind,weight\nspam,strict,\ndeal,soft,0.5\nwin,soft,1.5\nx9,soft,2\n")
    assert url_filter.vocabulary(spark, str(tmp_path / "v.csv")) == terms
    cases = {"a/spam": True, "a/deal": False, "a/deal/win": True, "a/win/win": False, "a/x9": False, "a/x9/deal": True, "a/x99/deal": False, "ax9-deal": False}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    assert [r.rejected for r in url_filter.judge(df, terms).orderBy("page_id").collect()] == list(cases.values())


def test_url_query_equals_another_search(spark):
    """Every term is looked for in every URL by a pattern of its own."""
    terms = url_filter.vocabulary()
    assert len(terms) > 150
    for r in queries.QUERIES["op7_url_filter"](spark, SF).collect():
        plain = re.sub("%([2-7][0-9a-fA-F])", lambda m: chr(int(m[1], 16)), r.url or "").lower()
        want = {t for t in terms if t in plain and re.search(rf"(?<![^\W\d_]){t}(?![^\W\d_])", plain)}
        hard = {t for t in want if terms[t] == float("inf")}
        soft = want - hard
        assert set(filter(None, r.terms.split(","))) == want and r.rejected == bool(hard or (len(soft) > 1 and sum(terms[t] for t in soft) >= 2))


# --- search ---


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(0)
    n_terms = 40
    searcher = topk.Searcher(np.repeat(np.arange(20), 3), rng.integers(0, n_terms, 60), np.ones(60, int), 20, rng.integers(1, 500, n_terms).astype(float), 4000, 400_000)
    rows = []
    for b in range(60):
        n = 64
        hot = rng.choice(n_terms, 4, replace=False)
        key = np.unique(np.concatenate([np.repeat(np.arange(n), 4) * n_terms + np.tile(hot, n), rng.integers(0, n, 5) * n_terms + rng.integers(0, n_terms, 5)]))
        rows.append({"n": n, "doc_ids": (np.arange(n) + b * n).astype("<i8").tobytes(), "lengths": rng.integers(20, 300, n).astype("<i8").tobytes(), "owners": (key // n_terms).astype("<u1").tobytes(), "terms": (key % n_terms).astype("<i4").tobytes(), "counts": rng.integers(1, 9, len(key)).astype("<i4").tobytes()})
    got = {q: list(zip(i.tolist(), s.tolist())) for q, i, s in searcher.search(rows, 10)}
    for q in range(20):
        weight = np.zeros(n_terms)
        weight[searcher.terms[q]] = searcher.times[q]
        scores = Counter()
        for r in rows:
            doc, owner, term, value = searcher.parts(r)
            for d, t, v in zip(doc[owner].tolist(), term, value):
                scores[d] += v * weight[t]
        want = sorted(((d, s) for d, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:10]
        assert got.get(q, []) == want
    assert searcher.scored < 20 * len(rows)


def test_search_groups_of_queries(spark, monkeypatch):
    docs, items = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark").limit(5)
    whole = {tuple(r) for r in topk.search(docs, items).collect()}
    monkeypatch.setattr(topk, "QUERIES", 2)
    assert {tuple(r) for r in topk.search(docs, items).collect()} == whole and len(whole) == 50
    monkeypatch.setattr(topk, "VOCABULARY_BYTES", 0)  # an index for each group
    monkeypatch.setattr(topk, "STEP", 2)
    assert {tuple(r) for r in topk.search(docs, items).collect()} == whole


def test_scores_that_are_started_from_lose_nothing():
    """Of the blocks one in three gives each query's least score; the rest are searched from there, two at a time."""
    rng = np.random.default_rng(4)
    searcher = topk.Searcher(np.repeat(np.arange(9), 4), rng.integers(0, 30, 36), np.ones(36, int), 9, rng.integers(1, 400, 30).astype(float), 2000, 200_000)
    rows = []
    for b in range(30):
        key = np.unique(rng.integers(0, 64 * 30, 150))
        rows.append({"n": 64, "doc_ids": (np.arange(64) + b * 64).astype("<i8").tobytes(), "lengths": rng.integers(20, 300, 64).astype("<i8").tobytes(), "owners": (key // 30).astype("<u1").tobytes(), "terms": (key % 30).astype("<i4").tobytes(), "counts": rng.integers(1, 9, len(key)).astype("<i4").tobytes()})
    whole = {q: list(zip(i.tolist(), s.tolist())) for q, i, s in searcher.search(rows, 10)}
    for q, _, s in searcher.search(rows[::3], 10):
        searcher.least[q] = s[-1] if len(s) == 10 else 0
    again = {q: list(zip(i.tolist(), s.tolist())) for q, i, s in searcher.search(iter(rows), 10)}
    assert again == whole and len(whole) == 9


# --- toxicity ---


def _toxic_rows(n=600, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["an", "to", "ri", "se", "mo", "la", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    bad = ["grumbol", "snarfid", "blorkast"]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_obfuscated(spark):
    rows, labels = _toxic_rows()
    docs = spark.createDataFrame(rows, DOCS)
    taught = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.judge(docs, taught).collect()}
    assert all(got[d] == bool(t) for d, _, t in labels[400:])
    hidden = ["grumb0l", "g r u m b o l", "gruuumbol", "s.n.a.r.f.i.d", "$narf1d", "bl0rk4st", "b-l-o-r-k-a-s-t", "Blorkaaast!"]
    more = spark.createDataFrame(rows + [(1000 + i, f"to an {h} la ke") for i, h in enumerate(hidden)] + [(2000, "to an gr0und la ke 2000 mo-ri"), (2001, "g r u m p y")], DOCS)
    got = {r.doc_id: r.rejected for r in toxicity.judge(more, taught).collect()}
    assert all(got[1000 + i] for i in range(len(hidden))), [h for i, h in enumerate(hidden) if not got[1000 + i]]
    assert not got[2000] and not got[2001]
    kept = toxicity.without_toxic(more, taught)
    assert {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if not x} and kept.columns == ["doc_id", "text"]


def test_toxicity_on_labels_not_learned_from(spark):
    d, sf = table(spark, "/root/testdata/sf0.1", "documents"), "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    taught, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    x = {tuple(r[:2]): r[2] for r in toxicity.judge(d, taught).join(held, "doc_id").groupBy("toxic", "rejected").count().collect()}
    found, missed, wrong, right = x.get((1, True), 0), x.get((1, False), 0), x.get((0, True), 0), x.get((0, False), 0)
    assert found / (found + missed) > 0.7 and wrong / (wrong + right) < 0.01


def test_toxicity_on_a_split_that_settled_nothing(spark):
    """Two thirds of the labels teach and one tests, by a hash; no constant was chosen on this split."""
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    x = {tuple(r[:2]): r[2] for r in toxicity.judge(d, labels.filter(third > 0)).join(labels.filter(third == 0), "doc_id").groupBy("toxic", "rejected").count().collect()}
    found, missed, wrong, right = x.get((1, True), 0), x.get((1, False), 0), x.get((0, True), 0), x.get((0, False), 0)
    print("fresh split", found, missed, wrong, right)
    assert found / (found + missed) > 0.7 and wrong / (wrong + right) < 0.01


def test_long_texts_are_judged_by_their_densest_window():
    scorer = toxicity.Scorer({"grumbol.": 7.6, "snarf": 7.6}, None, 5.4)
    toxic, clean = "he is a grumbol", " and so it goes on"
    score = lambda *texts: scorer.judge(pa.array(texts))[1]
    pasted = score(*(toxic + clean * n for n in (0, 100, 1000, 10_000)), clean * 5000 + toxic + clean * 5000)
    assert min(pasted) >= scorer.threshold and len(set(pasted[2:])) == 1
    # by brute force over all windows
    rng = random.Random(1)
    for _ in range(30):
        w = [rng.choice(["grumbol", "snarfid", "snarfed"]) if rng.random() < 0.004 else "so" for _ in range(rng.randint(1, 3000))]
        sums = lambda part: 7.6 * len({x for x in part if x != "so"}) / (1 + len(part) / toxicity.HALF_WORDS)
        want = max(sums(w), *(sums(w[i : i + toxicity.WINDOW]) for i in range(max(1, len(w) - toxicity.WINDOW + 1))), 0)
        assert abs(score(" ".join(w))[0] - want) < 1e-5


def test_near_copies_take_no_evidence_away(spark):
    rows, labels = _toxic_rows(500)
    alone = toxicity.learn_terms(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0]
    rng = random.Random(2)
    base = rows[1][1].split() + [f"carpentry{chr(97 + i)}" for i in range(20)] + ["grumbol"]
    for d in range(1000, 1600):  # one toxic text, in each copy another word changed
        w = list(base)
        w[rng.randrange(len(w) - 1)] = f"other{d}"
        rows.append((d, " ".join(w)))
        labels.append((d, 1, 1))
    terms = toxicity.learn_terms(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0]
    stems = {t[:4] for t in terms}
    assert stems == {t[:4] for t in alone} == {"grum", "snar", "blor"}


def test_gate_lets_through_what_the_lattice_can_read(spark):
    model = toxicity.language_model(table(spark, SF, "documents"))
    scorer = toxicity.Scorer({"idiot.": 7.0, "loser.": 7.0, "trash.": 7.0, "moron.": 7.0, "idiôt.": 7.0}, model, 5.0)
    hidden = ["\u0456d\u0456\u043et", "l\u03bf\u0455\u0435r", "i - d - i - o - t", "i. d. i. o. t.", "i d i ô t", "tr ash", "mo ron", "los€r", "i·d·i·o·t", "i\u200bd\u200bi\u200bo\u200bt", "gas tr ash", "l0ser", "i d i o t"]
    got = scorer.judge(pa.array([f"{a}{h}{b}" for h in hidden for a, b in (("", ""), ("you are such a ", " and more"))]))[1]
    assert min(got) > 5, [h for i, h in enumerate(hidden) if min(got[2 * i : 2 * i + 2]) <= 5]
    clean = ["todos los errores de la lista", "los eruditos", "the extra shelf", "gas stupor, 100 % of it", "id io tas", "\u20ac 100", "", "é", "«»"]
    assert max(scorer.judge(pa.array(clean))[1]) == 0


def test_short_words_are_terms(spark):
    rows, labels = _toxic_rows()
    short = {"grumbol": "zog", "snarfid": "qua", "blorkast": "uk"}
    rows = [(d, " ".join(short.get(w, w) for w in t.split())) for d, t in rows] + [(1000, "to zoggan la quasi ukan"), (1001, "an zog ke")]
    got = {r.doc_id: r.rejected for r in toxicity.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[d] == bool(t) for d, _, t in labels) and got[1001] and not got[1000]


def test_viterbi_equals_all_readings():
    rng = np.random.default_rng(0)
    model = toxicity.LanguageModel(rng.integers(0, 64**3, 4000), rng.integers(1, 50, 4000))

    def readings(text):
        """(score, reading) of every way to read the text."""
        def go(i, context, last, score, read):
            if i == len(text):
                yield score + model.step(context, " ")[0], read
                return
            c = text[i]
            inner = text[:i].strip(" ") and text[i + 1 :].strip(" ")
            if c.isalpha() or c.isdigit():
                options = [(c, 0.0 if c.isalpha() or not (text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha()) else toxicity.DIGIT)]
            else:
                options = [(" ", toxicity.BLANK if inner else 0.0)] + [("", toxicity.DROP)] * bool(inner)
            options += [(x, toxicity.LEET) for x in toxicity.RESEMBLES.get(c, "")]
            pair = c != text[i - 2 : i - 1] and c != text[i + 1 : i + 2]
            for x, price in options:
                if x == "" or (x == " " and last in (" ", "")):
                    yield from go(i + 1, context, last, score - price, read)
                else:
                    gain, after = model.step(context, x)
                    yield from go(i + 1, after, x, score + gain - price, read + x)
                if x == last and x not in ("", " "):
                    yield from go(i + 1, context, last, score - price - (toxicity.PAIR if pair else toxicity.REPEAT), read)

        return go(0, (0, 0), "", 0.0, "")

    for text in ("l0ser", "a1!b", "aaab", "i-d", "7-1l", "g r 0"):
        best = max(readings(text))
        got = toxicity.decode(text, model)
        assert any(abs(s - best[0]) < 1e-5 and r == got for s, r in readings(text)), text


# --- tokens ---


def test_tokens_equal_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_bpe.MODEL)
    rng = random.Random(2)
    texts = ["", " ", "  x  y ", "\n\n", "a\nb\tc", "日本 語𝒳", "A\x00b", "<s>hi</s>", "x" * 3000, "ab" * 2000, " " * 70 + "x", "É" * 100, "a,b, c,", "don't. Stop."]
    texts += ["".join(rng.choice("abcdeth  inor.,;:!\n\té日0123xyzXYZ") for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    tables, known = sp_bpe.Tables(sp_bpe.MODEL), {}
    ids, first = sp_bpe.encode_texts(tables, texts, known)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [sp.encode(t) for t in texts]
    data, at = tables.decode(ids, first)
    data = data.tobytes()
    assert [data[at[i] + 1 : at[i + 1]].decode() for i in range(len(texts))] == texts


def test_tokens_of_documents(spark, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_bpe.MODEL)
    got = sp_bpe.encode(table(spark, "/root/testdata/sf0.001", "documents"))
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = got.collect()
    assert all(r.round_trip and r.token_ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in rows) and len(rows) == len(texts)
    assert {tuple(r) for r in sp_bpe.decode(got).collect()} == set(texts.items())
    monkeypatch.setattr(sp_bpe, "REMEMBERED", 3)
    tables, known = sp_bpe.Tables(sp_bpe.MODEL), {}
    for _ in range(2):
        ids, _ = sp_bpe.encode_texts(tables, ["one two three four five"], known)
        assert ids.tolist() == sp.encode("one two three four five")


@pytest.mark.parametrize("signs", ["etaoinshrdlucmfwypvbgk", "ab", "aA1=-+/", "éü漢字😀ab", "theand"])
def test_tokens_of_long_words(signs, monkeypatch):
    """A text without spaces is one word: its tokens are the library's, and the times that all of it is gone over don't grow with it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_bpe.MODEL)
    tables, rng, calls = sp_bpe.Tables(sp_bpe.MODEL), random.Random(11), []
    rank_of = tables.rank_of
    monkeypatch.setattr(tables, "rank_of", lambda left, right: calls.append(len(left)) or rank_of(left, right))
    texts = ["".join(rng.choices(signs, k=k)) for k in (510, 511, 512, 513, 20_000)]
    for text in [*texts, " a b ".join(texts)]:
        ids, _ = sp_bpe.encode_texts(tables, [text], {})
        assert ids.tolist() == sp.encode(text)
    calls.clear()
    tables.encode_words(texts[-1:])
    assert len(calls) < 10
