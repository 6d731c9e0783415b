"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns of clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import decontaminate, html_consensus, line_dedup, pii, simhash, sp_bpe, suffix_index, topk, toxicity, url_filter
from helixmill.session import table

LONG = " ".join(f"word{i}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
LINE = "a line that is long enough to be compared"
# names that the operators use themselves
CLASHING = ("key", "rep", "fp", "h", "g", "line", "first", "k", "n", "kept", "group_id", "keys", "rest", "a", "b", "id", "root", "score", "rejected", "host", "path", "terms", "q", "units", "token_ids", "start_word", "run", "new", "item_id", "quality", "toxic")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


ROWS = [
    (1, PASSAGE + "\n" + LINE, "en", "s", 10), (2, PASSAGE + "\n" + LINE, None, None, None), (2, PASSAGE + "\n" + LINE, None, None, None), (None, PASSAGE, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, LONG, "en", "s", 1), (6, LONG, "en", "s", 1),
    (7, " \n\n\t ", "en", "s", 5), (8, "x", "", "", 1), (None, None, None, None, None), (9, "a" * 50_000, "en", "s", 1), (10, "word " * 20_000, "en", "s", 1), (11, "!!! ... \x00 \U0001f600", "en", "s", 1), (12, "4111111111111111 jo@example.com", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def test_simhash(odd, none):
    got = {(r.doc_id, r.group_id, r.kept) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 1, False), (5, 5, True), (6, 5, False)} == got
    left = simhash.without_near_duplicates(odd)
    assert left.count() == len(ROWS) - 3 and left.columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


#: Names that joins made, or might make; and others that only differ in letter case.
INNER = ("__id", "__dropped", "__kept", "__host", "d", "gone", "row", "_d", "_h", "th", "group", "copies", "win", "_k")


@pytest.fixture(scope="module")
def repeats(spark):
    """A doc_id whose rows differ, and one whose rows are the same."""
    other = PASSAGE.replace("passage", "quite another text of")
    rows = [(1, PASSAGE), (2, PASSAGE), (2, other), (3, other + " more"), (4, "so it is\nnobody else's words, in a line of their own"), (4, "so it is\nnobody else's words, in a line of their own"), (4, PASSAGE.upper() + " end"), (None, other), (5, None), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in (*CLASHING, *INNER)}).repartition(3), other


def test_simhash_keeps_rows_that_share_only_a_doc_id(repeats):
    docs, other = repeats
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, PASSAGE), (2, other), (4, "so it is\nnobody else's words, in a line of their own"), (0, other), (5, ""), (5, "")])
    groups = sorted((r.doc_id, r.group_id, r.kept) for r in simhash.near_duplicates(docs).collect())
    assert groups == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 1, False), (4, 4, False), (4, 4, True)]


def test_lines_of_rows_that_share_only_a_doc_id(repeats):
    docs, other = repeats
    left = line_dedup.without_duplicate_lines(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, PASSAGE), (2, other), (3, other + " more"), (4, "so it is\nnobody else's words, in a line of their own"), (4, PASSAGE.upper() + " end"), (0, other), (5, ""), (5, "")])


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination_of_rows_that_share_only_a_doc_id(spark, repeats, most):
    docs, other = repeats
    left = decontaminate.without_contaminated(docs, bench(spark, [(1, PASSAGE)]), most)
    assert left.columns == docs.columns and {r.doc_id for r in left.filter("contains(text, 'quite another')").collect()} == {2, 3, None}
    assert left.filter("contains(lower(text), 'passage')").count() == 0 and left.count() == 7


def test_lines(odd, none):
    got = {tuple(r) for r in line_dedup.duplicate_lines(odd).collect()}
    assert got == {(2, 0, 1, 0), (2, 1, 1, 1), (6, 0, 5, 0)}
    left = line_dedup.without_duplicate_lines(odd)
    assert left.columns == odd.columns and left.count() == len(ROWS) - 3
    assert line_dedup.duplicate_lines(none).count() == 0 and line_dedup.without_duplicate_lines(none).count() == 0


def test_passages(odd, none):
    got = {tuple(r) for r in suffix_index.repeated_passages(odd).collect()}
    assert got == {(2, 0, 89, 89, 1), (6, 0, 60_000, 60_000, 5), (10, 1, 20_000, 19_999, 10)}
    assert suffix_index.repeated_passages(none).count() == 0


def test_passages_of_rows_that_repeat_a_doc_id(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (1, "before it " + PASSAGE), (2, PASSAGE)]
    assert {tuple(r) for r in suffix_index.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()} == {(1, 2, 82, 80, 1), (2, 0, 80, 80, 1)}


def test_pii(odd, none):
    assert {(r.doc_id, r.kind) for r in pii.spans(odd).collect()} == {(12, "CREDIT_CARD"), (12, "EMAIL")}
    assert pii.redact(odd).count() == len(ROWS) and pii.spans(none).count() == 0 and pii.redact(none).count() == 0


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination(spark, odd, none, most):
    items = bench(spark, [(1, PASSAGE), (1, PASSAGE), (2, None), (None, PASSAGE), (3, ""), (4, "word word"), (5, " ".join(PASSAGE.split()[10:30]))])
    got = {(r.doc_id, r.item_id, r.span_words) for r in decontaminate.contaminated(odd, items, most).collect()}
    assert got == {(1, 1, 80), (2, 1, 80), (1, 5, 20), (2, 5, 20)}
    assert decontaminate.contaminated(odd, bench(spark, []), most).count() == 0 and decontaminate.contaminated(none, items, most).count() == 0


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination_filter(spark, odd, most):
    left = decontaminate.without_contaminated(odd, bench(spark, [(1, PASSAGE)]), most)
    assert left.columns == odd.columns and left.count() == len(ROWS) - 3


def test_pages(spark):
    rows = [(1, None, None), (None, "http://a.b/", "<p>x"), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (3, "", "<div><p>" + "t " * 100_000), (4, "http://a.b/xxx", "<div class='" + "c " * 5000 + "'>text" + "<div>" * 5000), (5, "::", "no markup")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHING})
    got = html_consensus.extract(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got if r.page_id in (1, 2, 5)} == {1: None, 2: "", 5: ""}
    assert len(next(r.text for r in got if r.page_id == 3)) == 199_999
    assert html_consensus.extract(df.limit(0)).count() == 0
    urls = url_filter.judge(df).collect()
    assert len(urls) == len(rows) and sum(r.rejected for r in urls) == 1 and url_filter.judge(df.limit(0)).count() == 0


def test_search(spark, odd, none):
    items = bench(spark, [(1, "passage1 passage2"), (1, "passage1 passage2"), (2, None), (None, "x"), (3, ""), (4, "nobodyhasthis"), (5, "word5")])
    got = [(r.item_id, r["rank"], r.doc_id) for r in topk.search(odd, items).collect()]
    assert sorted(got) == sorted([(1, 1, 1), (1, 2, 2), (1, 3, 2)] * 2 + [(5, 1, 5), (5, 2, 6)])
    assert topk.search(none, items).count() == 0 and topk.search(odd, bench(spark, [])).count() == 0


def test_toxicity(spark, odd, none):
    for rows in ([], [(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (99, 1, 1), (2, 1, 1)]):
        got = toxicity.judge(odd, labels(spark, rows))
        assert got.count() == len(ROWS) and got.filter("rejected").count() == 0
        left = toxicity.without_toxic(odd, labels(spark, rows))
        assert left.columns == odd.columns and left.count() == len(ROWS)
        assert toxicity.judge(none, labels(spark, rows)).count() == 0 and toxicity.without_toxic(none, labels(spark, rows)).count() == 0


def test_tokens(odd, none):
    got = sp_bpe.encode(odd).collect()
    assert len(got) == len(ROWS) and all((r.token_ids is None) == (r.n_tokens is None) == (r.round_trip is None) for r in got)
    assert sum(r.token_ids is None for r in got) == 2 and all(r.round_trip for r in got if r.token_ids is not None) and next(r for r in got if r.doc_id == 4).token_ids == []
    assert sp_bpe.encode(none).count() == 0 and sp_bpe.decode(sp_bpe.encode(odd)).filter("text is null").count() == 2


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, none, tmp_path, k):
    labels(spark, [(1, 1, 1), (2, 0, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, [(1, "nothing of this kind stands in any of the documents that there are here at all")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    _, stage = corpus_pipeline.STAGES[k]
    out, empty = stage(spark, odd, str(tmp_path)), stage(spark, none, str(tmp_path))
    assert out.count() >= len(ROWS) - 3 and empty.count() == 0
    assert out.columns == (odd.columns if k < len(corpus_pipeline.STAGES) - 1 else ["doc_id", "n_tokens", "token_ids", "round_trip"])


def test_pipeline_over_empty_and_repeated_rows(spark, tmp_path):
    rows = {"empty": [], "rows": [(1, PASSAGE), (1, PASSAGE), (1, "another text under the same number, of its own words"), (None, "nobody's text"), (2, None), (3, "")]}
    for name, some in rows.items():
        folder = tmp_path / name
        documents(spark, [(d, t, "en", "s", len(t or "")) for d, t in some]).withColumns({"__id": F.lit(1), "__dropped": F.lit(2)}).write.parquet(str(folder / "documents.parquet"))
        labels(spark, []).write.parquet(str(folder / "labels.parquet"))
        bench(spark, []).write.parquet(str(folder / "benchmark.parquet"))
        got = sorted((r.doc_id or 0, r.n_tokens or 0) for r in corpus_pipeline.run(spark, str(folder)).collect())
        assert [d for d, _ in got] == ([] if name == "empty" else [0, 1, 1, 2, 3])


def test_pipeline_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.judge(docs, table(spark, sf, "labels")).filter("rejected").collect()}
    kept = {d: t for d, t in kept.items() if d not in toxic}
    drop: dict = {}
    again = lambda: spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    for r in line_dedup.duplicate_lines(again()).collect():
        drop.setdefault(r.doc_id, set()).add(r.line)
    for d, lines in drop.items():
        left = [x for i, x in enumerate(kept[d].split("\n")) if i not in lines]
        if left:
            kept[d] = "\n".join(left)
        else:
            del kept[d]
    gone = {r.doc_id for r in simhash.near_duplicates(again()).filter("not kept").collect()}
    kept = {d: t for d, t in kept.items() if d not in gone}
    gone = {r.doc_id for r in decontaminate.contaminated(again(), table(spark, sf, "benchmark")).collect()}
    kept = {d: t for d, t in kept.items() if d not in gone}
    got = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in sp_bpe.decode(got).collect()} == set(kept.items()) and len(kept) > 100
