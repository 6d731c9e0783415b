"""Search, pages, graph and snapshot with a transport that replays replies; stopped and resumed; and what fails."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helixmill.operators import documents as DOC
from helixmill.operators import graph as G
from helixmill.operators import ingest as I
from helixmill.operators import jobs as J
from helixmill.operators import ner as N
from helixmill.operators import retrieval as R
from helixmill.operators import snapshots as SN
from helixmill.sources import articles as SRC
from helixmill.sources import store

GENES = ["brca", "tpfive", "egfr", "kras", "myc"]


def article(i: int) -> str:
    text = f"{GENES[i % 5]} and {GENES[(i * i + 1) % 5]} were seen"
    return f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>Study {i}</ArticleTitle><Abstract><AbstractText>{text}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"


class Fake:
    """A service of 47 articles; a page at or beyond ``fails_at`` fails."""

    def __init__(self, count: int = 47, fails_at: int | None = None):
        self.count, self.fails_at = count, fails_at

    def get(self, endpoint, params):
        if endpoint == "esearch.fcgi":
            found = {"count": str(self.count)}
            return json.dumps({"esearchresult": found | ({"webenv": "E", "querykey": "1"} if params.get("usehistory") else {"idlist": [str(i) for i in range(min(self.count, int(params["retmax"])))]})})
        if "id" in params:
            ids = [int(i) for i in params["id"].split(",")]
        else:
            a = int(params["retstart"])
            if self.fails_at is not None and a >= self.fails_at:
                raise OSError("the service is gone")
            ids = range(a, min(self.count, a + int(params["retmax"])))
        return f"<PubmedArticleSet>{''.join(map(article, ids))}</PubmedArticleSet>"


def provider(spark):
    return N.dictionary_provider(spark.createDataFrame([(g, "GENE") for g in GENES], "term string, entity_type string"))


def rows(graph):
    nodes, edges = graph
    return sorted((r.id, r.frequency, tuple(sorted(r.sources))) for r in nodes.collect()), sorted((r.source_id, r.target_id, r.weight, tuple(sorted(r.sources))) for r in edges.collect())


def test_job_that_is_killed_goes_on_to_the_same_graph(spark, tmp_path):
    cursor = SRC.search_with_history(Fake(), "x")
    assert cursor == {"web_env": "E", "query_key": "1", "count": 47}
    at_once = I.ingest(spark, Fake(), cursor, provider(spark), str(tmp_path / "a"), "j", batch_size=10, snapshot_folder=str(tmp_path / "snap"))
    assert (at_once["last_retstart"], at_once["batches"], at_once["whole"]) == (47, 5, True)
    with pytest.raises(Exception, match="gone"):
        I.ingest(spark, Fake(fails_at=20), cursor, provider(spark), str(tmp_path / "b"), "j", batch_size=10, persist_every=2)
    graph, at, batches = I._state(spark, str(tmp_path / "b"))
    assert (at, batches) == (20, 2)
    I.ingest(spark, Fake(), cursor, provider(spark), str(tmp_path / "b"), "j", batch_size=10, persist_every=2)
    again = I.ingest(spark, Fake(), cursor, provider(spark), str(tmp_path / "b"), "j", batch_size=10)
    assert again["batches"] == 5
    whole, parts = I._state(spark, str(tmp_path / "a"))[0], I._state(spark, str(tmp_path / "b"))[0]
    assert rows(whole) == rows(parts) and sum(n for _, n, _ in rows(whole)[0]) == sum(1 if i % 5 == (i * i + 1) % 5 else 2 for i in range(47))
    assert rows(SN.load(spark, str(tmp_path / "snap"), "job", "j")) == rows(whole)
    assert I.articles_so_far(spark, str(tmp_path / "b")).count() == 47


def test_caps_and_modes(spark, tmp_path):
    cursor = {"web_env": "E", "query_key": "1", "count": 60}
    short = I.ingest(spark, Fake(), cursor, provider(spark), str(tmp_path / "c"), "j", batch_size=10, persist_every=1, max_batches=2)
    assert short["last_retstart"] == 20 and short["batches"] == 2
    late = I.ingest(spark, Fake(), cursor, provider(spark), str(tmp_path / "d"), "j", mode="deferred_ner", batch_size=30, persist_every=1)
    assert late["last_retstart"] == 60 and I._state(spark, str(tmp_path / "d"))[0][0].count() == 0
    assert I.entities_later(spark, str(tmp_path / "d"), provider(spark), "j")[0].count() == 5


def test_topic_run(spark, tmp_path):
    log, graph = I.run_topic(spark, Fake(), "x", provider(spark), None, str(tmp_path / "s"), "2024-W01", "t")
    assert [(r.step, r.ok) for r in log.collect()] == [(s, True) for s in ("search", "fetch", "entities", "graph", "snapshot")] and J.run_status(log).first().status == "success"
    log, same = I.run_topic(spark, Fake(), "x", lambda a: 1 / 0, graph, str(tmp_path / "s"), "2024-W02", "t")
    assert [r.ok for r in log.collect()] == [True, True, False] and same is graph and J.run_status(log).first().status == "partial"


def test_source_reads_a_recorded_search(spark, tmp_path):
    fake = Fake(25)
    record = lambda endpoint, params: (tmp_path / SRC.RecordedTransport.name_of(endpoint, params)).write_text(fake.get(endpoint, params))
    record("esearch.fcgi", SRC.search_request("x", history=True))
    cursor = {"web_env": "E", "query_key": "1"}
    for a, n in SRC.pages(25, 10):
        record("efetch.fcgi", SRC.fetch_request(cursor, a, n))
    record("efetch.fcgi", SRC.fetch_by_id_request(["3", "4"]))
    spark.dataSource.register(SRC.ArticleSource)
    df = spark.read.format("articles").options(term="x", batchsize="10").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and sorted(int(r.pmid) for r in df.collect()) == list(range(25))
    assert {r.pmid for r in spark.read.format("articles").option("pmids", "3, 4").load(str(tmp_path)).collect()} == {"3", "4"}
    assert len(SRC.fetch_by_id_request([str(i) for i in range(300)])["id"].split(",")) == 200
    assert SRC.fetch_articles(spark, fake, ["5"]).first().title == "Study 5" and SRC.search_ids(fake, "x", 3) == ["0", "1", "2"]


def test_sinks(spark, tmp_path):
    folder = str(tmp_path)
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")

    def put(name, content):
        if name == "b":
            raise OSError("full")
        return f"store/{name}"

    def local(name, content):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
        return f"{folder}/{name}"

    assert sorted(tuple(r) for r in store.store_objects(files, put, local).collect()) == [("a", "store/a", None), ("b", f"{folder}/b", "full")] and (tmp_path / "b").read_bytes() == b"2"

    def post(event):
        with open(f"{folder}/posted-{json.loads(event)['k']}", "w") as f:
            f.write(event)

    assert [r.status for r in store.notify(spark.createDataFrame([(1,), (2,)], "k int"), post).collect()] == ["sent", "sent"] and (tmp_path / "posted-2").exists()


def test_first_of_graphs_and_versions(spark, tmp_path):
    good = (spark.createDataFrame([("a",), ("",)], "id string"), spark.createDataFrame([("a", "b"), (None, "b")], "source_id string, target_id string"))
    none = (good[0].limit(0), good[1].limit(0))
    missing = lambda: (spark.read.parquet(str(tmp_path / "none")),) * 2
    assert [t.count() for t in store.first_graph(spark, [missing, lambda: none, lambda: good])] == [1, 1]
    assert [t.count() for t in store.first_graph(spark, [missing])] == [0, 0]
    assert [store.write_version(good[0].limit(k), str(tmp_path / "t")) for k in (1, 2)] == [0, 1] and store.read_current(spark, str(tmp_path / "t")).count() == 2
    new = spark.createDataFrame([("k", "b"), ("k", "a")], "id string, v string").repartition(2)
    assert [r.v for r in store.upsert(new.limit(0), new, ["id"]).collect()] == ["b"]


def test_relation_models(spark):
    articles = spark.createDataFrame([("1", "Aspirin treats pain but not gout")], "pmid string, text string")
    e = spark.createDataFrame([("1", "DISEASE", 0, "pain"), ("1", "DISEASE", 1, "gout"), ("1", "DRUG", 0, "Aspirin")], "pmid string, entity_type string, entity_seq int, text string")
    seen = N.pair_relations(lambda texts: [("treats", 0.9) if "[E2]Aspirin[/E2] treats [E1]pain" in t else ("NO_RELATION", 0.9) if "Aspirin" in t else ("binds", 0.4) for t in texts])(e, articles)
    assert [(r.subject, r.relation, r.object) for r in seen.collect()] == [("pain", "treats", "Aspirin")]
    p = N.relation_prompts(e, articles.union(spark.createDataFrame([("2", "x")], articles.schema))).orderBy("pmid").collect()
    assert [r.status for r in p] == ["ok", "skipped"] and p[0].prompt.startswith("Entities: pain (DISEASE), gout (DISEASE), Aspirin (DRUG)") and p[1].prompt is None
    replies = spark.createDataFrame([("1", '```json\n{"relations": [{"subject": "a", "relation": "Treats", "object": "b"}, {"subject": "a", "relation": "odd", "object": "b"}]}\n```'), ("2", "no"), ("3", "")], "pmid string, reply string")
    good, status = N.relations_of_replies(replies)
    assert [(r.pmid, r.relation) for r in good.collect()] == [("1", "treats")] and {r.pmid: r.status for r in status.collect()} == {"1": "ok", "2": "error", "3": "empty"}
    none = lambda a: spark.createDataFrame([], N.ENTITY_SCHEMA)
    found = N.with_fallback(none, provider(spark))(spark.createDataFrame([("1", "kras is absent")], "pmid string, text string"))
    assert [r.text for r in found.collect()] == ["kras"]
    assert N.with_assertions(found, spark.createDataFrame([("1", "kras is absent")], "pmid string, text string")).first().assertion_status == "NEGATED"
    assert N.Providers(default="d", d=provider(spark)).extract("nobody", articles).count() == 0


def test_filters_metadata_and_refinement(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], {"k": "a"}), (2, [1.0, 0.1], {"k": "b"})], "id int, embedding array<double>, metadata map<string,string>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<double>")
    assert [r.id for r in R.nearest(c, q, 5, where=F.col("metadata")["k"] == "b").collect()] == [2]
    d = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    out = DOC.index_documents(d, spark.createDataFrame([], "file_hash string"), metadata=spark.createDataFrame([(1, {"k": "own"})], "doc_id int, metadata map<string,string>"), base={"k": "base", "b": "1"})
    assert out.first().metadata == {"k": "own", "b": "1"}
    parts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id int, chunk_index int, content string")
    assert {tuple(r) for r in DOC.refine(parts, lambda s, x: F.concat(s, F.upper(x))).collect()} == {(1, "AB"), (2, "C")}


def test_betweenness_by_joins(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("c", "f"), ("x", "y")]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {"alone"})], "id string")
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    small = {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()}
    assert {r.id: r.betweenness for r in G.betweenness(nodes, edges, max_broadcast_bytes=0).collect()} == pytest.approx(small) and small["d"] > 0
