"""Operators on small inputs whose results are known."""

from __future__ import annotations

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from helixmill.operators import documents as DOC
from helixmill.operators import graph as G
from helixmill.operators import jobs as J
from helixmill.operators import memory as M
from helixmill.operators import ner as N
from helixmill.operators import retrieval as R
from helixmill.operators import signals as SG
from helixmill.operators import snapshots as SN
from helixmill.sources import articles as SRC
from helixmill.sources import store
from helixmill.streaming import graph_stream


def graph(spark, pairs, jobs=None, extra=()):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    nodes = spark.createDataFrame([(i, i, "T", 1, (jobs or {}).get(i, [])) for i in ids], "id string, label string, entity_type string, frequency long, job_ids array<string>")
    edges = spark.createDataFrame([(min(p[:2]), max(p[:2]), p[2] if len(p) > 2 else 1, "r", ["s"], ["j"]) for p in pairs], "source_id string, target_id string, weight long, relation_type string, sources array<string>, job_ids array<string>")
    return nodes, edges


def test_shapes(spark):
    for pairs, extra, n, density, between in [([("a", "b"), ("b", "c")], (), 1, 0.666667, {"b": 1.0}), ([("x", c) for c in "abcd"], (), 1, 0.4, {"x": 1.0}), ([("a", "b"), ("c", "d")], (), 2, 0.333333, {}), ([], ("a",), 1, 0.0, {})]:
        nodes, edges = graph(spark, pairs, extra=extra)
        s = G.graph_stats(nodes, edges).first()
        assert (s.components, s.density) == (n, density)
        assert {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect() if r.betweenness} == pytest.approx(between)


def test_bridge_path(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")], {"a": ["j1"], "b": ["j1", "j2"], "c": ["j2"]})
    assert {r.id: r.bridge_score for r in G.bridge_scores(nodes, edges).collect()} == {"a": 0.25, "b": 1.0, "c": 0.25}
    assert [r.id for r in G.top_bridges(nodes, edges).collect()] == ["b"]


def test_sampled_betweenness_scales(spark):
    nodes, edges = graph(spark, [(f"n{i:03}", f"n{(i + 1) % 60:03}") for i in range(60)])
    exact = {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()}
    sampled = {r.id: r.betweenness for r in G.betweenness(nodes, edges, exact_nodes=10, samples=60).collect()}
    assert sampled == pytest.approx(exact)


def test_betweenness_brute_force(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("c", "f")]
    nodes, edges = graph(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s, t):
        front = [[s]]
        while front:
            hit = [p for p in front if p[-1] == t]
            if hit:
                return hit
            front = [[*p, x] for p in front for x in near[p[-1]] if x not in p]
        return []

    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        ps = paths(s, t)
        for p in ps:
            for x in p[1:-1]:
                want[x] += 1 / len(ps) / 20
    assert {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()} == pytest.approx(want)


def test_paths_and_hops(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("q", "r")])
    assert tuple(G.shortest_path(nodes, edges, "a", "d").first()) == (["a", "b", "c", "d"], 3)
    assert G.shortest_path(nodes, edges, "a", "q").count() == 0 and G.shortest_path(nodes, edges, "a", "nobody").count() == 0
    assert tuple(G.shortest_path(nodes, edges, "a", "a").first()) == (["a"], 0)
    assert {(r.id, r.hop) for r in G.within_hops(edges, "a", 2).collect()} == {("b", 1), ("x", 1), ("c", 2)}


def mentions(spark, rows):
    """rows: (article, position, type, text, concept, job)."""
    return spark.createDataFrame([(str(a), a, 0, k, t, x, 0.5 + k / 10, c, "V" if c else None, None, j) for a, k, t, x, c, j in rows], "pmid string, article_seq int, type_seq int, entity_seq int, entity_type string, text string, confidence double, concept_id string, concept_source string, assertion_status string, job_id string")


def test_build_graph(spark):
    m = mentions(spark, [(1, 0, "drug", "Aspirin", None, "j1"), (1, 1, "disease", "Cancer", "mesh:D9", "j1"), (2, 0, "disease", "tumour", "MESH:D9", "j2"), (2, 1, "drug", " ASPIRIN", None, "j2"), (2, 2, "gene", "  ", None, "j2")])
    t = spark.createDataFrame([("1", 1, 0, "aspirin ", "treats", "CANCER", "j1"), ("2", 2, 0, "tumour", "causes", "Aspirin", "j2"), ("2", 2, 1, "tumour", "causes", "nobody", "j2"), ("1", 1, 1, "cancer", "is", "Cancer", "j1")], "pmid string, article_seq int, triplet_seq int, subject string, relation string, object string, job_id string")
    nodes, edges = G.build_graph(m, t)
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"DRUG::aspirin", "DISEASE::MESH:D9"}
    d = n["DISEASE::MESH:D9"]
    assert (d.label, d.frequency, d.sources, d.job_ids, d.aliases, d.confidence_max) == ("cancer", 2, ["1", "2"], ["j1", "j2"], ["cancer", "tumour"], 0.6)
    e = edges.collect()
    assert [(x.source_id, x.target_id, x.weight, x.relation_type, x.sources) for x in e] == [("DISEASE::MESH:D9", "DRUG::aspirin", 2, "treats", ["1", "2"])]
    old, new = (G.build_graph(m.filter(f"pmid = '{p}'"), t.filter(f"pmid = '{p}'")) for p in "12")
    merged = {r.id: (r.label, r.frequency, r.aliases) for r in G.merge_graphs(old, new)[0].collect()}
    assert merged == {i: (r.label, r.frequency, r.aliases) for i, r in n.items()}
    assert G.merge_edges(G.edge_mentions(t, m), by_relation=True).count() == 2


def test_snapshot_diff(spark, tmp_path):
    old, new = graph(spark, [("A", "B", 2), ("B", "C", 3)]), graph(spark, [("A", "B", 5), ("A", "D", 1)])
    flipped = old[1].select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight", "relation_type", "sources", "job_ids")
    for edges in (old[1], flipped):
        d = SN.edge_diff(new[1], edges)
        assert {(r.source_id, r.target_id, r.change, r.old_weight, r.new_weight) for r in d.collect()} == {("A", "D", "new_edge", None, 1), ("B", "C", "disappeared_edge", 3, None), ("A", "B", "weight_increased", 2, 5)}
    n = SN.node_diff(new[0], old[0])
    assert {tuple(r) for r in n.collect()} == {("D", "new_node"), ("C", "disappeared_node")}
    assert tuple(SN.diff_summary(n, d).first()) == (1, 1, 1, 1, 1, 0)
    folder = str(tmp_path / "s")
    SN.save(*old, folder, "week", "2026-W08")
    SN.save(*new, folder, "week", "2026-W12")
    SN.save(*new, folder, "week", "2026-W12")
    SN.save(*new, folder, "job", "j1")
    assert [r[0] for r in SN.labels(spark, folder).collect()] == ["2026-W08", "2026-W12"]
    assert SN.load(spark, folder, "week", "2026-W12")[1].count() == 2 and SN.load(spark, folder, "week", "2020-W01")[0].count() == 0
    assert SN.latest_as_of(SN.labels(spark, folder), "2026-W10").first()[0] == "2026-W08"
    doc = SN.to_document(*new, "2026-W12")
    assert json.loads(doc.first().document)["node_count"] == 3
    nodes, edges = SN.from_document(doc, "struct<id: string, label: string>", "struct<source_id: string, target_id: string, weight: long>")
    assert nodes.count() == 3 and edges.agg(F.sum("weight")).first()[0] == 6


def test_signals(spark):
    old, new = graph(spark, [("A", "B", 2), ("B", "C", 3), ("C", "D", 4)]), graph(spark, [("A", "B", 5), ("A", "D", 1), ("C", "D", 2)])
    kinds = {(r.source_id, r.target_id): r.signal_type for r in SG.broad_signals(new[1], old[1], include_disappeared=True).collect()}
    assert kinds == {("A", "B"): "growing_relation", ("A", "D"): "new_relation", ("B", "C"): "disappeared_relation", ("C", "D"): "declining_relation"}
    assert SG.broad_signals(new[1], old[1]).count() == 3
    assert [(r.entity_a, r.entity_b, r.signal_type) for r in SG.pair_signals(new[0], new[1], old[1], "a", "b").collect()] == [("A", "B", "growing_relation")]
    assert SG.pair_signals(new[0], new[1], old[1], "a", "c").first().signal_type == "no_direct_edge"
    assert SG.pair_signals(new[0], new[1], old[1], "zzz", "yyy").count() == 3


def test_assertions_fall_back(spark):
    pmids = spark.createDataFrame([("1",), ("2",)], "pmid string")
    stored = spark.createDataFrame([("1", "e", "NEGATED", 0.9)], "pmid string, entity_id string, assertion_status string, confidence double")
    articles = spark.createDataFrame([("1", "It may be so")], "pmid string, abstract string")
    assert SG.assertions_of(pmids, stored, articles).count() == 1
    assert {(r.pmid, r.assertion_status) for r in SG.assertions_of(pmids, stored, articles, "other").collect()} == {("1", "HYPOTHETICAL"), ("2", "PRESENT")}
    assert SG.consensus(SG.assertions_of(pmids, stored, articles, "other")).first().label == "contradictory"


def test_keyword_escapes(spark):
    a = spark.createDataFrame([("1", "50% more", "x" * 600), ("2", "500 more", "b")], "pmid string, title string, abstract string")
    found = R.keyword_search(a, "50% more").collect()
    assert [r.pmid for r in found] == ["1"] and len(found[0].abstract) == 501


def test_context_needs_labels(spark):
    nodes, edges = graph(spark, [("a", "b")])
    nodes = nodes.withColumn("label", F.when(F.col("id") == "a", "").otherwise("beta"))
    found, links = R.graph_context(nodes, edges, spark.createDataFrame([("the Beta test",)], "entity string"))
    assert [r.id for r in found.collect()] == ["b"] and links.count() == 0


def test_format_context(spark):
    d = spark.createDataFrame([(1, 2, "b", "B", [], 0), (1, 1, "a", "A", ["x", "y", "z", "w"], 2)], "query_id int, rank int, name string, content string, entities array<string>, n_relations int")
    assert R.format_context(d).first().context == "[Source 1: a]\nA\nEntities: x, y, z\nRelations: 2\n\n---\n\n[Source 2: b]\nB"


def test_memory(spark):
    m = spark.createDataFrame([(1, f"1-{k}", "user", f"t{k}", k) for k in range(60)], "conversation_id int, message_id string, role string, content string, created_at int")
    new = spark.createDataFrame([(1, "1-59", "user", "again", 59), (1, "1-60", "system", "no", 60)], m.schema)
    out = M.append(m, new).collect()
    assert len(out) == 50 and min(r.created_at for r in out) == 10 and {r.content for r in out if r.message_id == "1-59"} == {"again"}
    assert M.history_first(m, 1000).count() == 60 and M.history_first(m, 0).count() == 1


def test_orphan_calls(spark):
    rows = [(1, 0, "user", "hi", None, None), (1, 1, "assistant", "ok", ["a", "b"], None), (1, 2, "tool", "ra", None, "a"), (1, 3, "user", "go", None, None), (1, 4, "assistant", "", ["c"], None), (1, 5, "assistant", "x", ["d"], None), (1, 6, "tool", "rd", None, "d")]
    m = spark.createDataFrame(rows, "conversation_id int, seq int, role string, content string, call_ids array<string>, call_id string")
    assert [(r.seq, r.call_ids) for r in M.without_orphan_calls(m).orderBy("seq").collect()] == [(0, None), (1, []), (3, None), (5, ["d"]), (6, None)]


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(k, k + 120)) for k in range(0, 600, 120)) + "x" * 2500
    pieces = DOC.split_text(text, 1000, 200)
    assert all(0 < len(p) <= 1000 for p in pieces) and set(text.split()) - {"x" * 2500} <= {w for p in pieces for w in p.split()} | {text.split()[-1]}
    assert DOC.split_text("", 10, 2) == [] and DOC.split_sentences("A b. " * 2000, 100)[0].endswith(".")
    d = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id int, text string")
    assert {r.doc_id for r in DOC.chunk(d).collect()} == {1}


def test_quality_merge_summary(spark):
    pages = spark.createDataFrame([(1, k, "same page of words " * 10) for k in range(3)] + [(2, 0, " ".join(f"w{i}" for i in range(80))), (3, 0, "short"), (4, 0, None)], "doc_id int, page_no int, content string")
    assert {r.doc_id: r.reason for r in DOC.extraction_quality(pages).collect()} == {1: "repetitive_content", 2: "sufficient", 3: "insufficient_text", 4: "insufficient_text"}
    t = spark.createDataFrame([(1, 0, "aaa. bbb"), (1, 1, ""), (1, 2, "long " * 10), (1, 4, "")], "doc_id int, page_no int, content string")
    s = spark.createDataFrame([(1, 0, "aaa. ccc"), (1, 1, "scan"), (1, 2, "x"), (1, 3, "only")], "doc_id int, page_no int, content string")
    assert {r.page_no: (r.content, r.merge_method) for r in DOC.merge_scan(t, s).collect()} == {0: ("aaa. bbb\n\nccc", "combined"), 1: ("scan", "ocr_preferred"), 2: (("long " * 10).strip(), "text_preferred"), 3: ("only", "ocr_preferred"), 4: ("", "fallback")}
    assert {r.page_no for r in DOC.clean_pages(spark.createDataFrame([(1, 0, "x" * 30), (1, 1, " y ")], t.schema)).collect()} == {0}
    c = spark.createDataFrame([(1, k, str(k)) for k in range(12)] + [(2, 0, "z")], "doc_id int, chunk_index int, content string")
    assert {r.doc_id: r.content for r in DOC.tree_reduce(c, lambda parts: F.array_join(parts, ""), 5).collect()} == {1: "01234567891011", 2: "z"}
    a, b = t.filter("page_no < 2"), s
    assert DOC.better_loader(a, b).count() == 4


def test_index_documents(spark):
    d = spark.createDataFrame([(1, "hello " * 10), (2, "hello " * 10), (3, "old"), (4, "new text")], "doc_id int, text string")
    seen = d.filter("doc_id = 3").select(DOC.content_hash(F.col("text")).alias("file_hash"))
    assert {r.doc_id for r in DOC.index_documents(d, seen, F.array(F.length("content"))).collect()} == {1, 4}


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", "pending"), ("b", "completed"), ("c", "failed"), ("d", "pending")], "job_id string, status string")
    events = spark.createDataFrame([("a", 1, "running"), ("a", 2, "completed"), ("a", 3, "running"), ("b", 1, "running"), ("c", 1, "running"), ("d", 1, "completed")], "job_id string, seq int, to_status string")
    assert {r.job_id: r.status for r in J.apply_transitions(jobs, events).collect()} == {"a": "completed", "b": "completed", "c": "running", "d": "pending"}
    rows = spark.createDataFrame([(1, None, "x", None), (2, None, "y", None)], "id int, deleted_at timestamp, name string, updated_at timestamp")
    now = F.lit(dt.datetime(2024, 1, 1))
    assert J.active(J.soft_delete(rows.withColumn("created_at", F.lit(1)), spark.createDataFrame([(1,)], "id int"), now)).count() == 1
    out = {r.id: (r.name, r.updated_at is None) for r in J.update(rows, spark.createDataFrame([(2, "z")], "id int, name string"), now).collect()}
    assert out == {1: ("x", True), 2: ("z", False)}
    assert J.insert(rows, rows.withColumn("id", F.col("id") + 1)).count() == 3
    topics = spark.createDataFrame([("t", "u", True, dt.datetime(2023, 1, 1), "weekly", 5, None, 20, "abc")], "topic_id string, user_id string, is_active boolean, next_run_at timestamp, frequency string, total_articles_found long, last_search_at timestamp, max_results int, query string")
    assert J.after_run(topics, now).first().next_run_at == dt.datetime(2024, 1, 7) and J.invalid_topics(topics).count() == 0
    found, have = spark.createDataFrame([("t", "u", "1"), ("t", "u", "2")], "topic_id string, user_id string, pmid string"), spark.createDataFrame([("u", "1")], "user_id string, pmid string")
    history, new, totals = J.run_search(topics, found, have, now)
    assert history.first().new_articles == 1 and [r.pmid for r in new.collect()] == ["2"] and totals.first().total_articles_found == 6
    steps = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "run_id int, ok boolean")
    assert {tuple(r) for r in J.run_status(steps).collect()} == {(1, "partial"), (2, "success"), (3, "failed")}
    assert spark.range(1).select(J.pick_pmids(F.lit(" 1, ,2,3"), 2)).first()[0] == ["1", "2"]
    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2023, 12, 31, 23, 59)), ("b", dt.datetime(2020, 1, 1))], "key string, stored_at timestamp")
    assert J.cache_after(e, now, 3600, 10).count() == 1
    clock, slept = [0.0], []
    limiter = J.RateLimiter(2, lambda: clock[0], slept.append)
    assert [limiter.wait() for _ in range(3)] == [0.0, 0.5, 1.0] and slept == [0.5, 1.0]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert J.with_retries(flaky, 3, lambda i: 0, lambda s: None) == "ok"


XML = """<S><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><Year>2026</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><ForeName>X</ForeName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>M1</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC7</ArticleId><ArticleId IdType="doi">10/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>2</PMID></MedlineCitation></PubmedArticle></S>"""
WANT = ("1", "T", "A", "J", "Mar 2026", ["Jo Doe"], ["M1"], "PMC7", "10/x", "https://pubmed.ncbi.nlm.nih.gov/1/", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7/pdf/")


def test_article_sources(spark, tmp_path):
    df = spark.createDataFrame([(XML,), ("<broken",), (None,)], "xml string")
    assert [tuple(r) for r in SRC.articles_of(df).collect()] == [WANT]
    (tmp_path / "a.xml").write_text(XML)
    assert [tuple(r) for r in SRC.read_articles(spark, str(tmp_path)).collect()] == [WANT]
    spark.dataSource.register(SRC.ArticleSource)
    assert [tuple(r) for r in spark.read.format("articles").option("batchsize", "1").load(str(tmp_path)).collect()] == [WANT]
    assert SRC.pages(450, 200) == [(0, 200), (200, 200), (400, 50)] and SRC.pages(1000, 900)[0] == (0, 500)
    assert SRC.search_request("x", 99999, -1, mindate="2020")["retmax"] == "10000" and SRC.search_request("x", history=True)["retmax"] == "0"
    with pytest.raises(ValueError):
        SRC.search_cursor("{}")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f.txt").write_text("p1\fp2")
    assert [r.content for r in SRC.read_pages(spark, str(tmp_path / "t")).orderBy("page_no").collect()] == ["p1", "p2"]


def _doc(i="9|None"):
    a = lambda k, t, kind, ident: {"id": k, "text": t, "infons": {"type": kind, "identifier": ident}, "locations": [{"offset": 3, "length": 4}]}
    return {"_id": i, "passages": [{"annotations": [a("1", "BRAF", "Gene", "673"), a("2", "braf", "Gene", "673"), a("3", "cancer", "Disease", "MESH:D9"), a("4", "x", "Gene", "1"), a("5", "thing", "Odd", "7")]}],
            "relations": [{"infons": {"type": "Bind", "role1": {"normalized_name": "BRAF"}, "role2": {"identifier": "MESH:D9"}}}, {"infons": {"type": "Association", "entity1": "1", "entity2": "MESH:D9"}}, {"infons": {"type": "Association"}, "nodes": [{"refid": "3"}, {"refid": "1"}]}, {"infons": {"type": "Nope", "entity1": "1", "entity2": "3"}}, {"infons": {"type": "Bind", "entity1": "1", "entity2": "2"}}]}


@pytest.mark.parametrize("wrap", [lambda d: {"PubTator3": [d]}, lambda d: [d], lambda d: d])
def test_annotations(spark, wrap):
    docs = SRC.annotations_of(spark.createDataFrame([(json.dumps(wrap(_doc())),), (json.dumps([_doc(SRC.SENTINEL)]),)], "json string"))
    assert [(r.pmid, r.entity_type, r.text, r.start, r.end, r.concept_id) for r in N.document_entities(docs).orderBy("entity_type").collect()] == [("9", "DISEASE", "cancer", 3, 7, "MESH:D9"), ("9", "GENE", "BRAF", 3, 7, "NCBIGene:673")]
    assert [(r.subject, r.relation, r.object) for r in N.document_relations(docs).orderBy("triplet_seq").collect()] == [("BRAF", "binds", "cancer"), ("BRAF", "associated_with", "cancer"), ("cancer", "associated_with", "BRAF")]
    asked = spark.createDataFrame([("8", 0), ("9", 1)], "pmid string, position int")
    assert [r.error is None for r in N.fill_missing(asked, N.document_entities(docs)).orderBy("position").collect()] == [False, True]
    assert SRC.request_chunks(asked).first().pmids == ["8", "9", SRC.SENTINEL]


def test_providers(spark):
    a = spark.createDataFrame([("1", "Aspirin treats cancer. Aspirin is old."), ("2", "boom"), ("3", None)], "pmid string, text string")
    gazetteer = spark.createDataFrame([("aspirin", "DRUG"), ("cancer", "DISEASE"), ("breast cancer", "DISEASE")], "term string, entity_type string")
    p = N.Providers(dictionary=N.dictionary_provider(gazetteer))
    found = p.extract("dictionary", a)
    assert {(r.entity_type, r.text, r.start, r.end) for r in found.collect()} == {("DRUG", "Aspirin", 0, 7), ("DISEASE", "cancer", 15, 21)}
    assert p.extract("dictionary", a, ("DRUG",)).count() == 1
    with pytest.raises(KeyError):
        p.extract("nobody", a)

    def model(texts):
        if "boom" in texts:
            raise RuntimeError
        return [[{"entity_type": "GENE", "text": t[:3], "confidence": 0.6 if t else 0.9}] for t in texts]

    p.register("gliner", N.batched(model))
    assert p.extract("gliner", a.filter("pmid <> '3'")).count() == 0  # below that provider's confidence
    rel = N.co_mention_relations(found, a)
    assert [tuple(r) for r in rel.collect()] == [("1", "Aspirin", "treats", "cancer")]
    good, bad = N.known_relations(spark.createDataFrame([("a", "Associated With", "b"), ("a", "odd", "b")], "subject string, relation string, object string"))
    assert good.first().relation == "associated_with" and bad.first().relation == "odd"
    assert N.valid_types(["gene", "odd"], N.DEFAULT_TYPES) == ["GENE"] and len(N.valid_types(["odd"], N.DEFAULT_TYPES)) == 4
    with pytest.raises(ValueError):
        N.valid_types(["odd"], N.DEFAULT_TYPES, strict=True)
    assert N.entity_pairs(found).count() == 1
    nodes, links = G.relation_graph(rel.withColumn("object", F.lit("pain")), mentions(spark, [(1, 0, "DRUG", "aspirin", None, "j")]))
    assert {(r.text, r.entity_type) for r in nodes.collect()} == {("Aspirin", "DRUG"), ("pain", "UNKNOWN")}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "pmid string, title string")
    assert {tuple(r) for r in store.upsert_articles(old, spark.createDataFrame([("2", None), ("3", "c"), (None, "x")], old.schema)).collect()} == {("1", "a"), ("2", ""), ("3", "c")}
    f = str(tmp_path / "t")
    store.write_version(old, f)
    store.write_version(old.limit(1), f)
    assert store.read_current(spark, f).count() == 1
    _, edges = graph(spark, [("a", "b", 1)])
    turned = edges.select(F.lit("b").alias("source_id"), F.lit("a").alias("target_id"), F.lit(9).cast("long").alias("weight"), "relation_type", "sources", "job_ids")
    assert [r.weight for r in store.upsert_edges(edges, turned).collect()] == [9]


def test_stream_equals_batch(spark, tmp_path):
    m = mentions(spark, [(a, k, "gene", f"g{(a * k) % 5}", None, "j") for a in range(12) for k in range(4)])
    for part in range(3):
        m.filter(f"article_seq % 3 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    schema = m.schema
    for _ in range(2):  # the second run finds nothing new
        graph_stream.merge_batches(graph_stream.mention_stream(spark, str(tmp_path / "in"), schema), target, checkpoint).awaitTermination()
    got = {r.id: (r.label, r.frequency, r.sources) for r in graph_stream.current_nodes(spark, target).collect()}
    want = {r.id: (r.label, r.frequency, sorted(r.sources)) for r in G.build_nodes(m).collect()}
    assert got == want
