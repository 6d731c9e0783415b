"""Queries against their SQL on tables that the test data don't hold, and how often they read a table."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import scoring as S
from helixmill.operators import article_pairs as P
from helixmill.operators import graph as G
from helixmill.operators import retrieval as R
from helixmill.operators import signals as SG
from helixmill.operators import snapshots as SN
from helixmill.plans import more
from helixmill.plans import queries as Q
from tests.conftest import SF
from tests.oracle import assert_equal


def folder(spark, at, **tables) -> str:
    """The test tables with some of them replaced."""
    for name in os.listdir(SF):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{SF}/{name}", f"{at}/{name}")
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_normalize_text_keeps_quotes_as_its_sql_does(spark, tmp_path):
    texts = ['a "word"', '"x"', "'x'", '("Straße").', ' \t"Ménière"\n', "", '"', "(a)", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    at = folder(spark, tmp_path, documents=docs)
    assert_equal(Q.QUERIES["normalize_text"](spark, at), at, Q.ORACLE_SQL["normalize_text"])


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def vectors(spark, n: int, seed: int):
    r = np.random.default_rng(seed)
    v = r.integers(-2, 3, (n, 6)).astype(float)  # with zeros, copies and equal similarities
    return v, spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, embedding array<float>")


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_nearest_in_blocks_of_queries_equals_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(R, "SPREAD", 10)
    v, chunks = vectors(spark, 300, 1)
    w, queries = vectors(spark, 90, 2)
    found = R.nearest(chunks, queries.select((F.col("id") + 1000).alias("query_id"), F.col("embedding").alias("query")), 7, threshold=threshold, max_broadcast_bytes=1000)
    assert "Join" not in plan(found)
    want = set()
    for i, q in enumerate(w):
        with np.errstate(invalid="ignore"):
            sim = v @ q / np.sqrt((v * v).sum(1) * (q @ q))
        best = sorted((-round(s, 9), k) for k, s in enumerate(sim) if s >= (-2 if threshold is None else threshold))[:7]
        want |= {(i + 1000, k, rank) for rank, (_, k) in enumerate(best, 1)}
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want


def test_retrieve_scores_a_document_before_it_meets_its_neighbours(spark):
    p = plan(Q.QUERIES["hybrid_rerank"](spark, SF))
    assert p.index("Join LeftOuter") < p.index("array_intersect") and p.count("regexp_extract_all(") == 1


def test_jaccard_of_sets(spark):
    rows = [(["A", "b", "a"], ["B", "c"]), ([], ["a"]), (["a"], []), (["x"], ["X"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 0, 0, 1, 0])


def some_mentions(spark, articles: int, seed: int):
    """Articles of up to nine mentions: texts of several types, in other letters, blank or null, equal seqs, jobs of no name."""
    r = random.Random(seed)
    rows = []
    for a in range(articles):
        pmid = r.choice([f"p{a}", f"p{a}", f"p{a}", "" if a == 3 else f"q{a}", None if a % 17 == 5 else f"q{a}"])
        for _ in range(r.randrange(9)):
            rows.append((pmid, a, r.randrange(4), r.randrange(3), r.choice(["gene", "drug"]), r.choice(["a", " A", "b", "c ", "é", "d", "  ", None]), 0.5, r.choice([None, None, None, "mesh:1"]), None, None, r.choice(["j1", "j2", "", None]), r.choice(["x", "y", None])))
    return spark.createDataFrame(rows, "pmid string, article_seq int, type_seq int, entity_seq int, entity_type string, text string, confidence double, concept_id string, concept_source string, assertion_status string, job_id string, relation string").dropDuplicates(["article_seq", "type_seq", "entity_seq", "text"]).cache()


def pairs_by_hand(rows, by_relation: bool):
    """weight, first relation, sources, jobs of each edge; where equal seqs make an order open, mentions have other texts."""
    out, articles = {}, {}
    for m in rows:
        if m.pmid is not None and m.text is not None and m.text.strip(" "):
            articles.setdefault((m.article_seq, m.pmid), []).append(m)
    for (seq, pmid), found in sorted(articles.items()):
        found.sort(key=lambda m: (m.type_seq, m.entity_seq))
        node = {}
        for m in found:
            node[m.text.strip(" ").lower()] = m.node_id
        for m in found:
            for o in found:
                a, b = node[m.text.strip(" ").lower()], node[o.text.strip(" ").lower()]
                if (m.type_seq, m.entity_seq) < (o.type_seq, o.entity_seq) and a != b:
                    k = (min(a, b), max(a, b), *([m.relation] if by_relation else []))
                    e = out.setdefault(k, [0, m.relation, [], []])
                    e[0] += 1
                    for v, at in ((pmid, 2), (m.job_id, 3)):
                        if v and v not in e[at]:
                            e[at].append(v)
    return out


@pytest.mark.parametrize("rows,pairs", [(P.ROWS, P.PAIRS), (7, 5)])
@pytest.mark.parametrize("by_relation", [False, True])
def test_edges_of_articles_equal_pairs_by_hand(spark, rows, pairs, by_relation, monkeypatch):
    parts = P.edge_parts
    monkeypatch.setattr(P, "edge_parts", lambda *a: parts(*a, rows, pairs))
    m = some_mentions(spark, 60, 3).dropDuplicates(["article_seq", "type_seq", "entity_seq"])
    want = pairs_by_hand(G.with_node_ids(m).collect(), by_relation)
    lists = {(r.source_id, r.target_id, *([r.relation_type] if by_relation else [])): [r.weight, r.relation_type, r.sources, r.job_ids] for r in G.article_edges(m, F.col("relation"), by_relation).collect()}
    assert {k: [*v[:3], sorted(v[3])] for k, v in lists.items()} == {k: [*v[:3], sorted(v[3])] for k, v in want.items()}
    counts = {(r.source_id, r.target_id, *([r.relation_type] if by_relation else [])): (r.weight, r.n_sources, sorted(r.job_ids)) for r in G.article_edges(m, F.col("relation"), by_relation, lists=False, counts=True, jobs=True).collect()}
    assert counts == {k: (v[0], len(v[2]), sorted(v[3])) for k, v in want.items()}


def test_edges_of_equal_seqs_are_not_pairs(spark):
    m = spark.createDataFrame([("1", 1, 1, 1, "T", t, None, "j", "r") for t in "ab"] + [("1", 1, 1, 2, "T", "c", None, "j", "r")], "pmid string, article_seq int, type_seq int, entity_seq int, entity_type string, text string, concept_id string, job_id string, relation string")
    assert {(r.source_id, r.target_id, r.weight) for r in G.article_edges(m, F.col("relation"), lists=False).collect()} == {("T::a", "T::c", 1), ("T::b", "T::c", 1)}


def test_links_join_what_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(P, "LINKED", 6)
    m = some_mentions(spark, 40, 5).withColumn("entity_type", F.concat("entity_type", (F.col("article_seq") % 13).cast("string")))
    nodes = G.with_node_ids(m.filter("pmid is not null")).select(F.col("node_id").alias("id")).distinct()
    found, want = ({tuple(r) for r in G.components(nodes, e).collect()} for e in (G.article_links(m), G.co_occurrences(m)))
    assert found == want and G.article_links(m).count() < G.co_occurrences(m).distinct().count()


def test_nodes_with_jobs_alone(spark):
    m = some_mentions(spark, 60, 7)
    names = ["id", "label", "entity_type", "frequency", "confidence_max", "concept_id", F.sort_array("job_ids").alias("job_ids")]
    assert {str(r) for r in G.build_nodes(m, lists=False, jobs=True).select(*names).collect()} == {str(r) for r in G.build_nodes(m).select(*names).collect()}


READS = {"kg_edges": 1, "k_hop_neighbors": 1, "snapshot_round_trip": 2, "snapshot_round_trip_edges": 2, "graph_context_edges": 2, "node_with_neighbors": 2, "job_snapshot_edges": 2, "top_edges": 1, "connected_components": 2, "emergence_scores": 2, "node_neighbors": 1, "signals_pair": 3, "signals_broad_top20": 2, "node_degrees": 2, "node_link_edges": 2, "job_breadth": 2, "top_nodes_degree": 2, "kg_edges_by_relation": 1}


@pytest.mark.parametrize("name", READS)
def test_lines_are_read_once_for_each_table_of_the_graph(spark, name, monkeypatch):
    seen = []
    for module, f in ((G, "cut"), (SG, "cut"), (R, "cut"), (SN, "cut"), (more, "_kept"), (SN, "save")):
        real = getattr(module, f)
        monkeypatch.setattr(module, f, lambda *a, real=real: (seen.extend(plan(x) for x in a if hasattr(x, "_jdf")), real(*a))[1])
    seen.append(plan(Q.QUERIES[name](spark, SF)))
    assert sum(len(re.findall(r"Relation \[l_orderkey", p)) for p in seen) == READS[name]
