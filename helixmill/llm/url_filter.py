"""URL filter by a weighted vocabulary.

One Aho-Corasick automaton finds all strict and soft terms of a URL in one pass. A hit counts if it is bounded: the
characters before and after it are no letters (digits, for a term that begins or ends with one). A URL is rejected for
one strict term, or where the weights of its distinct soft terms add up to ``LEAST_SOFT``, which takes two of them at least.
The URL is lower-cased and percent escapes of printable ASCII are undone first.

The vocabulary is a table (term, kind, weight): ``url_vocabulary.csv`` beside this module, or any CSV or Parquet table that
Spark can read, by its path. The driver reads it; it goes to every task, as vocabularies have thousands of terms.

Defined results. Every row has a row in the result. A null or empty URL has no hits and isn't rejected. Rows that repeat
are judged each for itself, a null page_id is kept. URLs are searched whole. Other columns are ignored. Of a vocabulary's
rows of one term a strict one counts, then the heaviest; null, empty and other kinds are left out. An empty vocabulary
rejects nothing.
"""

from __future__ import annotations

import csv
import io
import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "url_vocabulary.csv"
LEAST_SOFT = 2.0
_ESCAPE = "%(2[0-9a-f]|[3-6][0-9a-f]|7[0-9a-e])"


def _terms(rows) -> dict[str, float]:
    """Weights by term, infinite for strict ones."""
    out: dict[str, float] = {}
    for term, kind, weight in rows:
        if term and kind in ("strict", "soft"):
            w = float("inf") if kind == "strict" else float(weight or 1)
            out[term.lower()] = max(w, out.get(term.lower(), 0.0))
    return out


def vocabulary(spark: SparkSession | None = None, path: str | None = None) -> dict[str, float]:
    """The module's terms, or those of the table at ``path``."""
    if path is None:
        rows = csv.DictReader(io.StringIO(pkgutil.get_data("helixmill.llm", VOCABULARY).decode()))
        return _terms((r["term"], r["kind"], r["weight"]) for r in rows)
    table = spark.read.csv(path, header=True) if path.endswith((".csv", ".txt")) else spark.read.parquet(path)
    return _terms(tuple(r) for r in table.select("term", "kind", "weight").collect())


def _plain(url: str) -> str:
    return re.sub(_ESCAPE, lambda m: chr(int(m[1], 16)), url.lower()).lower()


def _kin(a: str, b: str) -> bool:
    return b.isalpha() if a.isalpha() else b.isdigit()


def hits(urls: list[str | None], automaton) -> Iterator[set[str]]:
    """Distinct terms of each URL."""
    for url in urls:
        found = set()
        if url:
            url = _plain(url)
            for end, term in automaton.iter(url):
                start = end - len(term)
                if (start < 0 or not _kin(term[0], url[start])) and (end + 1 >= len(url) or not _kin(term[-1], url[end + 1])):
                    found.add(term)
        yield found


def automaton_of(terms: dict[str, float]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _judge(terms: dict[str, float], least_soft: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton_of(terms)
        strict = {t for t, w in terms.items() if w == float("inf")}
        for batch in batches:
            found = list(hits(batch.column("url").to_pylist(), a))
            hard = [sorted(x & strict) for x in found]
            soft = [sorted(x - strict) for x in found]
            weight = [round(sum(terms[t] for t in x), 6) for x in soft]
            rejected = [bool(x) or (w >= least_soft and len(y) > 1) for x, y, w in zip(hard, soft, weight)]
            columns = [pa.array([len(x) for x in hard], pa.int32()), pa.array([len(x) for x in soft], pa.int32()), pa.array(weight, pa.float64()), pa.array([",".join(x + y) for x, y in zip(hard, soft)], pa.string()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "n_strict", "n_soft", "soft_weight", "terms", "rejected"])

    return run


def judge(pages: DataFrame, terms: dict[str, float] | None = None, least_soft: float = LEAST_SOFT) -> DataFrame:
    """(page_id, url, n_strict, n_soft, soft_weight, terms, rejected) of every row; counts are of distinct terms."""
    terms = vocabulary() if terms is None else terms
    schema = "page_id long, url string, n_strict int, n_soft int, soft_weight double, terms string, rejected boolean"
    if not terms:
        return pages.select("page_id", "url", F.lit(0).alias("n_strict"), F.lit(0).alias("n_soft"), F.lit(0.0).alias("soft_weight"), F.lit("").alias("terms"), F.lit(False).alias("rejected"))
    return pages.select("page_id", "url").mapInArrow(_judge(terms, least_soft), schema)


def oracle_sql(least_soft: float = LEAST_SOFT) -> str:
    """DuckDB's equal for terms of letters, with percent escapes of letters undone."""
    values = ", ".join(f"('{t}', {int(w == float('inf'))}, {0 if w == float('inf') else w})" for t, w in vocabulary().items())
    plain = "lower(url)"
    for code in range(0x61, 0x7B):
        for sign in (code, code - 32):
            plain = f"replace({plain}, '%{sign:02x}', '{chr(code)}')"
    return rf"""
WITH t(term, strict, weight) AS (VALUES {values}),
d AS (SELECT DISTINCT url AS u, {plain} AS p FROM pages),
h AS (SELECT u, string_agg(term, ',' ORDER BY strict DESC, term) AS terms, CAST(sum(strict) AS INTEGER) AS n_strict, CAST(sum(1 - strict) AS INTEGER) AS n_soft, CAST(sum(weight) AS DOUBLE) AS soft_weight
      FROM d JOIN t ON contains(p, term) AND regexp_matches(p, '(^|[^\p{{L}}])' || term || '([^\p{{L}}]|$)') GROUP BY u)
SELECT page_id, url, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(soft_weight, 0) AS soft_weight, coalesce(terms, '') AS terms,
       coalesce(n_strict, 0) > 0 OR (coalesce(soft_weight, 0) >= {least_soft} AND n_soft > 1) AS rejected
FROM pages LEFT JOIN h ON h.u = url
"""
