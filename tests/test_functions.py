"""Golden cases, and scalars against small Python functions of our own."""

from __future__ import annotations

import datetime as dt
import math
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.functions import collections as C
from helixmill.functions import dates as D
from helixmill.functions import scoring as S
from helixmill.functions import text as T

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_normalize_golden(spark):
    cases = {"  Myocardial   Infarction ": "myocardial infarction", "COVID-19": "covid-19", "BRCA1 ": "brca1", "Ménière's (disease).": "meniere's (disease", "": "", None: None}
    for exact in (False, True):
        assert column(spark, cases, lambda x, e=exact: T.normalize_entity_text(x, e)) == list(cases.values())


def _normalize(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.lower().split()).strip(T.EDGE_SIGNS)


@QUICK
@given(st.lists(st.text(alphabet="abcXYZ éèüñÇ.,;()'\"-\t 0123", max_size=30), min_size=1, max_size=40))
def test_normalize_equals_python(spark, values):
    for exact in (False, True):
        assert column(spark, values, lambda x, e=exact: T.normalize_entity_text(x, e)) == [_normalize(v) for v in values]


@QUICK
@given(st.lists(st.text(max_size=30), min_size=1, max_size=200))
def test_normalize_equals_python_on_all_of_unicode(spark, values):
    assert column(spark, values, T.normalize_entity_text) == [_normalize(v) for v in values]


def test_normalize_compatibility_forms(spark):
    cases = {"\ufb01brosis": "fibrosis", "CO\u2082": "co2", "Vi\u1ec7t": "viet", "\uff15": "5", "\u0391\u03ac": "\u03b1\u03b1", "a\u00a0b": "a b", "\u2460x": "1x"}
    assert column(spark, cases, T.normalize_entity_text) == list(cases.values())


def _repaired(s: str) -> str:
    """Repairs of scans, sign by sign."""
    word = lambda c: c.isalnum() or c == "_"
    s = s.replace("|", "I").replace("0", "O")

    def joined(s: str, wanted) -> str:
        out, i = "", 0
        while i < len(s):
            j = i + 1
            while j < len(s) and s[j].isspace():
                j += 1
            if word(s[i]) and j > i + 1 and j < len(s) and word(s[j]) and wanted(s, i, j):
                out, i = out + s[i], j
            else:
                out, i = out + s[i], i + 1
        return out

    def three(s, i, j):
        for _ in range(2):  # one sign, blanks, one sign, blanks, one sign
            k = j + 1
            while k < len(s) and s[k].isspace():
                k += 1
            if k == j + 1 or k >= len(s) or not word(s[k]):
                return False
            j = k
        return True

    def single(s, i, j):
        return (i == 0 or not word(s[i - 1])) and (j + 1 == len(s) or not word(s[j + 1]))

    t = " ".join(joined(joined(s, three), single).split())
    for d in "123456789":
        t = t.replace(f"{d} . ", f"{d}. ")
    return t


@QUICK
@given(st.lists(st.text(alphabet="ab é|0 1.\n\tüñ日5_-", max_size=25).map(lambda x: x.strip()), min_size=1, max_size=100))
def test_scan_repairs_equal_another_program(spark, values):
    assert column(spark, values, T.clean_ocr_text) == [_repaired(v) for v in values]


def test_scan_repairs_know_accented_letters(spark):
    assert column(spark, ["é t u d e de l"], T.clean_ocr_text) == ["étud e de l"]


def test_concepts_and_node_ids(spark):
    assert column(spark, ["mesh:D009369", " NCBIGene:673 ", "x", "a:b:c"], T.normalize_concept_id) == ["MESH:D009369", "NCBIGENE:673", "x", "A:b:c"]
    row = spark.range(1).select(T.make_node_id(F.lit("disease"), F.lit("Cancer"), F.lit("mesh:D009369")), T.make_node_id(F.lit("drug"), F.lit("Aspirin"))).first()
    assert tuple(row) == ("DISEASE::MESH:D009369", "DRUG::aspirin")


def test_resolve_concept(spark):
    cases = [("MESH:D1", "DISEASE", ("MESH:D1", "MeSH")), ("673", "GENE", ("NCBIGene:673", "NCBIGene")), ("rs334", "MUTATION", ("dbSNP:rs334", "dbSNP")), ("tmVar:c.1A>G", "MUTATION", ("tmVar:c.1A>G", "tmVar")), ("None", "GENE", None), ("-", "GENE", None), (None, "GENE", None), ("a;b", "DRUG", ("MESH:a", "MeSH")), ("x", "MUTATION", None), ("foo:", "GENE", None), ("omim:1,2", "DISEASE", ("OMIM:1", "OMIM"))]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(T.resolve_concept(F.col("a"), F.col("b")).alias("r"))
    assert [tuple(r.r) if r.r else None for r in df.collect()] == [c for _, _, c in cases]


def test_assertions(spark):
    cases = [("Patient has no hypertension", "hypertension", "NEGATED"), ("Further trials may confirm efficacy", "efficacy", "HYPOTHETICAL"), ("History of diabetes", "diabetes", "HISTORICAL"), ("Patient presents with fever", "fever", "PRESENT"), ("Nothing", "fever", "PRESENT"), ("It may not cause pain", "pain", "NEGATED")]
    df = spark.createDataFrame(cases, "t string, e string, w string")
    assert all(r.s == r.w for r in df.select(T.assertion_status(F.col("t"), F.col("e")).alias("s"), "w").collect())
    assert column(spark, ["There was no  evidence of it", "It may play a role", "previously reported", "", None, "plain"], T.abstract_status) == ["NEGATED", "HYPOTHETICAL", "HISTORICAL", "PRESENT", "PRESENT", "PRESENT"]
    assert spark.range(1).select(T.assertion_of_labels(F.array(F.lit("odd"), F.lit("absent"), F.lit("past")))).first()[0] == "NEGATED"


def test_emergence_golden(spark):
    cases = [(1, 0, 1, 43.16, "STABLE"), (5, 0, 3, 72.99, "EMERGING_SIGNAL"), (15, 2, 5, 72.28, "EMERGING_SIGNAL"), (3, 1, 2, 51.0, "ACCELERATING_TREND"), (10, 10, 10, 31.56, "STABLE"), (2, 8, 2, 11.35, "DECLINING"), (0, 5, 0, 6.69, "DECLINING"), (50, 0, 10, 99.4, "EMERGING_SIGNAL")]
    df = spark.createDataFrame(cases, "c long, p long, n long, s double, k string")
    for r in df.select("s", "k", S.emergence(F.col("c"), F.col("p"), F.col("n")).alias("x")).withColumn("y", S.classify_signal(F.col("x"))).collect():
        assert math.isclose(r.s, r.x, abs_tol=0.005) and r.k == r.y


def test_consensus_rules(spark):
    cases = [(9, 1, 0, 0, "confirmed"), (8, 2, 0, 0, "mixed"), (4, 0, 6, 0, "preliminary"), (5, 3, 2, 0, "contradictory"), (2, 6, 2, 0, "refuted"), (4, 6, 0, 0, "contradictory"), (0, 0, 0, 0, "insufficient_data")]
    df = spark.createDataFrame(cases, "p int, n int, h int, o int, w string").withColumn("t", F.expr("p + n + h + o"))
    share = lambda c: F.when(F.col("t") > 0, F.round(F.col(c) / F.col("t"), 4)).otherwise(0.0)
    assert all(r.w == r.x for r in df.select("w", S.classify_consensus(share("p"), share("n"), share("h"), F.col("t")).alias("x")).collect())


def test_sanitizers(spark):
    assert column(spark, ["Résumé", "Projet été", "café", "éèàù", None], T.ascii_only) == ["Rsum", "Projet t", "caf", "", ""]
    assert column(spark, ["a\x00b ", None], T.sanitize_text) == ["a b", None]
    assert column(spark, ["x", None], T.valid_utf8) == ["x", ""]
    assert column(spark, ["1 .  a |b 10"], T.clean_ocr_text) == ["1. a Ib 1O"]


def test_weeks(spark):
    days = [dt.date(2026, 3, 19), dt.date(2024, 12, 30)]
    assert column(spark, days, D.week_label, "date") == ["2026-W12", "2025-W01"]
    assert column(spark, ["2026-W12", "2025-W01", "x"], D.parse_week_label) == [dt.date(2026, 3, 16), dt.date(2024, 12, 30), None]
    assert column(spark, days, lambda d: D.week_label_offset(d, 1), "date") == ["2026-W11", "2024-W52"]


@QUICK
@given(st.lists(st.dates(dt.date(1990, 1, 1), dt.date(2060, 1, 1)), min_size=1, max_size=50))
def test_weeks_equal_python(spark, days):
    assert column(spark, days, D.week_label, "date") == [d.strftime("%G-W%V") for d in days]
    assert column(spark, days, lambda d: D.parse_week_label(D.week_label(d)), "date") == [d - dt.timedelta(d.weekday()) for d in days]


def test_schedules(spark):
    def run(day, frequency, f=D.next_run):
        return spark.range(1).select(f(F.lit(day).cast("date"), F.lit(frequency))).first()[0]

    assert run("2024-01-07", "weekly") == dt.datetime(2024, 1, 14) == run("2024-01-10", "weekly")
    assert run("2024-12-15", "monthly") == dt.datetime(2025, 1, 1) and run("2024-12-15", "daily") is None
    assert run("2024-01-07", "weekly", D.next_run_scheduler) == dt.datetime(2024, 1, 21)
    assert run("2024-01-31", "monthly", D.next_run_scheduler) == dt.datetime(2024, 3, 1) and run("2024-01-07", "x", D.next_run_scheduler) == dt.datetime(2024, 1, 14)
    assert column(spark, [dt.datetime(2024, 1, 1)], lambda t: D.job_expiry(t, F.lit("failed")), "timestamp") == [dt.datetime(2024, 1, 31)]


def test_query_builder(spark):
    want = 'base AND ("Randomized Controlled Trial"[Publication Type] OR "Review"[Publication Type]) AND ("Nature"[Journal]) AND eng[Language] AND ("Mice"[Organism])'
    assert T.entrez_query("base", ["RCT", "Review"], ["Nature"], "eng", ["Mice"]) == want
    a = lambda *x: F.array(*map(F.lit, x))
    assert spark.range(1).select(T.entrez_query_column(F.lit("base"), a("RCT", "Review"), a("Nature"), F.lit("eng"), a("Mice"))).first()[0] == want
    assert T.entrez_query("only") == "only"


def test_markers_json_links(spark):
    r = spark.range(1).select(T.mark_entities(F.lit("ab cd ef"), F.lit(6), F.lit(8), F.lit(0), F.lit(2)), T.find_offset(F.lit("Hello"), F.lit("LL")), T.find_offset(F.lit("Hello"), F.lit("x")), T.links(F.lit("see https://a.b/c. and [x](http://d.e)")), T.reply_status(F.lit("```json\n{\"a\": 1}\n```")), T.reply_status(F.lit("nope")), T.parse_model_json(F.lit("```json\n{\"a\": 1}\n```"), "a int")["a"]).first()
    assert list(r) == ["[E2]ab[/E2] cd [E1]ef[/E1]", 2, None, ["https://a.b/c", "http://d.e"], "ok", "error", 1]


def test_collections(spark):
    r = spark.range(1).select(C.append_absent(F.array(F.lit("a")), F.lit("b")), C.append_absent(F.array(F.lit("a")), F.lit("a")), C.entity_json(F.lit("x"), F.lit(None).cast("double"), start=F.lit(1), end=F.lit(None).cast("int")), C.first_joined(F.array(*map(F.lit, "abcd")), 3), F.to_json(C.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))).first()
    assert list(r) == [["a", "b"], ["a"], '{"text":"x","confidence":null,"start":1}', "a, b, c", '{"a":1,"b":3}']
    rows = C.explode_lists(spark.createDataFrame([("p", {"GENE": ["a", "b"]})], "pmid string, e map<string, array<string>>"), "e").collect()
    assert [tuple(x) for x in rows] == [("p", "GENE", 0, "a"), ("p", "GENE", 1, "b")]


def test_retry_and_limits():
    assert S.retry_delay(3, chance=lambda: 0.5) == 8.0 and S.retry_delay(20, chance=lambda: 1.0) == 90.0
    assert round(1 / S.least_interval(True), 1) == 9.5
