"""Further queries, for operators that the others don't show: each over its whole table, with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import collections as C
from helixmill.functions import dates as D
from helixmill.functions import text as T
from helixmill.operators import documents as DOC
from helixmill.operators import graph as G
from helixmill.operators import jobs as J
from helixmill.operators import memory as M
from helixmill.operators import ner as N
from helixmill.operators import signals as SG
from helixmill.operators import snapshots as SN
from helixmill.plans import adapters as A
from helixmill.plans.queries import NOW, WITH_EDGES, WITH_NODES, query
from helixmill.session import shared_dir, table
from helixmill.sources import articles as SRC
from helixmill.sources import store

# --- functions ---


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')) AS h FROM documents")
def ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.ascii_only(F.col("text"))).alias("h"))


@query()
def scan_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs look ahead, which the oracle's patterns can't; tests compare with another program."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_ocr_text(F.col("text")).alias("content"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(date_trunc('day', o_orderdate) AS DATE) + 7 + CAST(7 - isodow(o_orderdate + INTERVAL 7 DAY) % 7 AS INTEGER)
 WHEN o_orderkey % 3 = 1 THEN CAST(date_trunc('month', o_orderdate + INTERVAL 30 DAY) AS DATE) ELSE CAST(o_orderdate AS DATE) + 7 END AS day FROM orders""")
def next_run_scheduler(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_orderkey") % 3 == 0, "weekly").when(F.col("o_orderkey") % 3 == 1, "monthly").otherwise("odd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(D.next_run_scheduler(F.col("o_orderdate"), k)).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'base' END AS a, c_name AS b, c_custkey % 4 = 0 AS both FROM customer")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.when(F.col("c_custkey") % 4 == 0, F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.col("c_name"))).otherwise(F.create_map(F.lit("b"), F.col("c_name")))
    m = C.merge_maps(F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("gone")), over)
    return table(spark, sf_dir, "customer").select("c_custkey", m["a"].alias("a"), m["b"].alias("b"), (F.map_values(m)[0] == "own").alias("both"))


@query("WITH p AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_slice(a, 1, 3), ', ') AS shown, array_to_string(a, '') || array_to_string(a, '') AS twice FROM p")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of an order's parts, cut for display, and put one after another."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), F.array(F.col("l_partkey").cast("string")).alias("p"))
    both = one.select("l_orderkey", F.struct(F.lit(0).alias("k"), "o").alias("o"), "p").union(one.select("l_orderkey", F.struct(F.lit(1).alias("k"), "o").alias("o"), "p"))
    found = both.groupBy("l_orderkey").agg(C.concat_lists(F.col("p"), F.col("o")).alias("all"))
    half = F.slice("all", F.lit(1), (F.size("all") / 2).cast("int"))
    return found.select("l_orderkey", C.first_joined(half, 3).alias("shown"), F.array_join("all", "").alias("twice"))


@query(f"WITH {A.MENTIONS_SQL} SELECT pmid, entity_type, CAST(row_number() OVER (PARTITION BY pmid, entity_type ORDER BY seq) - 1 AS INTEGER) AS entity_seq, text AS entity FROM m")
def exploded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of lists of entities by type, for each article, as rows again."""
    m = A.mentions(spark, sf_dir)
    lists = m.groupBy("pmid", "entity_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("article_seq", "type_seq", "entity_seq", "text"))), lambda x: x["text"]).alias("l"))
    maps = lists.groupBy("pmid").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "l"))).alias("e"))
    return C.explode_lists(maps, "e")


@query("SELECT c_custkey, list_slice(list_filter([trim(x) for x in string_split(c_name || ', , ' || c_mktsegment || ',' || c_custkey, ',')], lambda x: x <> ''), 1, 2)[1] AS a, list_slice(list_filter([trim(x) for x in string_split(c_name || ', , ' || c_mktsegment || ',' || c_custkey, ',')], lambda x: x <> ''), 1, 2)[2] AS b FROM customer")
def picked_pmids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = J.pick_pmids(F.concat("c_name", F.lit(", , "), "c_mktsegment", F.lit(","), "c_custkey"), 2)
    return table(spark, sf_dir, "customer").select("c_custkey", p[0].alias("a"), p[1].alias("b"))


# --- articles and stores ---


@query("SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS abstract, 'Fore ' || c_custkey || ' Last' AS author, 'https://pubmed.ncbi.nlm.nih.gov/' || c_custkey || '/' AS pubmed_url FROM customer WHERE c_custkey % 5 > 0")
def parsed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as XML replies of the literature service; every fifth has no article."""
    k = F.col("c_custkey")
    abstract = F.when(k % 2 == 0, F.concat(F.lit("<Abstract><AbstractText>"), "c_mktsegment", F.lit("</AbstractText><AbstractText>second</AbstractText></Abstract>"))).otherwise("")
    article = F.when(k % 5 > 0, F.concat(F.lit("<Article><ArticleTitle>"), "c_name", F.lit("</ArticleTitle>"), abstract, F.lit("<AuthorList><Author><LastName>Last</LastName><ForeName>Fore "), k, F.lit("</ForeName></Author><Author><ForeName>Nameless</ForeName></Author></AuthorList></Article>"))).otherwise("")
    xml = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID>"), article, F.lit("</MedlineCitation></PubmedArticle></PubmedArticleSet>"))
    a = SRC.articles_of(table(spark, sf_dir, "customer").select(xml.alias("xml")))
    return a.select("pmid", "title", "abstract", F.array_join("authors", ";").alias("author"), "pubmed_url")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pmid FROM customer UNION ALL SELECT '12068308'")
def requested_pmids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is asked for, each once, in chunks of 50 and the sentinel in every one."""
    chunks = SRC.request_chunks(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pmid")))
    good = chunks.filter((F.size("pmids") <= 51) & F.array_contains("pmids", SRC.SENTINEL))
    asked = good.select("chunk", F.explode("pmids").alias("pmid")).filter(F.col("pmid") != SRC.SENTINEL).select("pmid")
    return asked.union(good.limit(1).select(F.lit(SRC.SENTINEL)))


@query("SELECT CAST(c_custkey AS VARCHAR) AS pmid, CASE WHEN c_custkey % 3 = 0 THEN 'newest' WHEN c_custkey % 3 = 1 THEN '' ELSE 'old' END AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || c_custkey || '/' AS pubmed_url FROM customer")
def articles_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the articles comes twice, a third without a title; the last write wins, null texts are empty."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("pmid"), F.lit("old").alias("title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), k, F.lit("/")).alias("pubmed_url"), F.lit(0).alias("n"))
    twice = rows.filter("pmid % 3 = 0").select("pmid", F.lit("new").alias("title"), F.lit("").alias("pubmed_url"), F.lit(1).alias("n"))
    new = twice.union(twice.select("pmid", F.lit("newest"), "pubmed_url", F.lit(2))).union(rows.filter("pmid % 3 = 1").select("pmid", F.lit(None).cast("string"), "pubmed_url", F.lit(3)))
    return store.upsert_articles(rows, new, F.col("n")).drop("n")


@query("SELECT doc_id, n FROM (SELECT doc_id, greatest(1, CAST(ceil(length(trim(text)) / 5000.0) AS BIGINT)) AS n, text FROM documents) WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 7) AND doc_id = (SELECT min(doc_id) FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 7)) AND length(trim(text)) <= 5000")
def existing_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that has the hash of document 7, and its chunks."""
    d = table(spark, sf_dir, "documents")
    chunks = DOC.index_documents(d, spark.createDataFrame([], "file_hash string"), size=5000)
    wanted = d.filter("doc_id = 7").select(T.content_hash(F.col("text"))).first()[0]
    return DOC.existing_chunks(chunks, wanted).select("doc_id", F.col("n_chunks").alias("n"))


# --- graph, snapshots, topics ---


@query(f"{WITH_NODES} SELECT node_id AS id, pmid, job_id, count(*) AS n FROM m GROUP BY ALL")
def node_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.provenance(A.mentions(spark, sf_dir))


@query(f"WITH {A.MENTIONS_SQL},{A.edges_sql('2000-06-01', NOW)} SELECT source_id, target_id, weight, relation_type FROM e")
def snapshot_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot as one JSON document, and read again."""
    m = A.mentions(spark, sf_dir).filter(A.span("2000-06-01", NOW))
    n, e = G.build_nodes(m, lists=False).select("id", "frequency"), A.edge_table(spark, sf_dir, "2000-06-01", NOW)
    document = SN.to_document(n, e, "2000-W26")
    return SN.from_document(document, "struct<id: string, frequency: long>", "struct<source_id: string, target_id: string, weight: long, relation_type: string>")[1]


@query(f"WITH {A.MENTIONS_SQL} SELECT node_id AS id, count(*) AS frequency FROM m WHERE day >= TIMESTAMP '2000-06-01' AND day < TIMESTAMP '{NOW}' GROUP BY 1")
def snapshot_document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mentions(spark, sf_dir).filter(A.span("2000-06-01", NOW))
    document = SN.to_document(G.build_nodes(m, lists=False).select("id", "frequency"), spark.createDataFrame([], "source_id string, target_id string"), "2000-W26")
    return SN.from_document(document, "struct<id: string, frequency: long>", "struct<source_id: string, target_id: string>")[0]


@query(f"WITH {A.MENTIONS_SQL} SELECT 'first' AS place, count(DISTINCT node_id) AS n FROM m WHERE day < TIMESTAMP '2000-06-08' UNION ALL SELECT 'second', count(DISTINCT node_id) FROM m WHERE day < TIMESTAMP '{NOW}'")
def snapshot_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two places that hold one label the first counts; a label that only the second holds comes from there."""
    m, (a, b) = A.mentions(spark, sf_dir), [f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}" for _ in range(2)]
    no_edges = spark.createDataFrame([("a", "b")], "source_id string, target_id string")
    early, late = (G.build_nodes(m.filter(A.span("1990-01-01", d)), lists=False).select("id") for d in ("2000-06-08", NOW))
    SN.save(early, no_edges, a, "week", "2000-W22")
    SN.save(late, no_edges, b, "week", "2000-W22")
    SN.save(late, no_edges, b, "week", "2000-W26")
    n = F.count(F.lit(1)).alias("n")
    both = [SN.load_first(spark, (a, b), "week", w)[0].agg(F.lit(p).alias("place"), n) for p, w in (("first", "2000-W22"), ("second", "2000-W26"))]
    return both[0].union(both[1])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE l_returnflag WHEN 'A' THEN 'NEGATED' ELSE 'PRESENT' END AS assertion_status FROM lineitem WHERE l_orderkey % 7 = 0 AND l_partkey % 2 = 0")
def assertions_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assertions of one kind of entity in the articles asked for."""
    line = table(spark, sf_dir, "lineitem")
    stored = line.select(F.col("l_orderkey").cast("string").alias("pmid"), (F.col("l_partkey") % 2).cast("string").alias("entity_id"), F.when(F.col("l_returnflag") == "A", "NEGATED").otherwise("PRESENT").alias("assertion_status"), F.lit(0.9).alias("confidence"))
    return SG.assertions_of(line.filter("l_orderkey % 7 = 0").select(F.col("l_orderkey").cast("string").alias("pmid")), stored, A.articles(spark, sf_dir), "0").select("pmid", "assertion_status")


@query("""WITH f AS (SELECT o_custkey AS topic_id, l_partkey AS pmid, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT DISTINCT topic_id, pmid FROM f WHERE d >= TIMESTAMP '2000-06-01' EXCEPT SELECT topic_id, pmid FROM f WHERE d < TIMESTAMP '2000-06-01')
SELECT c_custkey AS topic_id, c_custkey + coalesce(k, 0) AS total_articles_found, EXISTS (SELECT 1 FROM f WHERE topic_id = c_custkey AND d >= TIMESTAMP '2000-06-01') AS searched FROM customer LEFT JOIN (SELECT topic_id, count(*) AS k FROM n GROUP BY 1) ON topic_id = c_custkey""")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of topics after a search."""
    f = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("topic_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("pmid"), "o_orderdate")
    topics = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic_id"), F.col("c_custkey").alias("total_articles_found"), F.lit(None).cast("timestamp").alias("last_search_at"))
    _, _, totals = J.run_search(topics, f.filter("o_orderdate >= timestamp_ntz '2000-06-01'"), f.filter("o_orderdate < timestamp_ntz '2000-06-01'"), F.lit("2001-01-01").cast("timestamp"))
    return totals.select("topic_id", "total_articles_found", F.col("last_search_at").isNotNull().alias("searched"))


@query(f"{WITH_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1) SELECT id, degree, degree / 1000.0 >= 0.25 AND degree >= 260 AS is_bridge FROM d")
def flagged_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(A.node_table(spark, sf_dir, lists=False), A.edge_table(spark, sf_dir)).filter("degree > 0")
    return G.bridge_flag(d.withColumns({"bridge_score": F.col("degree") / 1000, "job_count": F.col("degree")}), 0.25, 260).select("id", "degree", "is_bridge")


# --- conversations and models ---


@query("""WITH c AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'tool' ELSE role END AS r FROM conversations WHERE turn < 1000),
b AS (SELECT *, sum(CASE WHEN r = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM c),
g AS (SELECT conv_id, block, max(CASE WHEN r <> 'tool' AND turn % 2 = 0 THEN 'c' || turn END) AS asked, list(CASE WHEN r = 'tool' AND turn % 4 > 0 THEN 'c' || (turn - 1) END) AS answered FROM b GROUP BY 1, 2)
SELECT b.conv_id AS conversation_id, turn AS seq, r AS role FROM b JOIN g USING (conv_id, block) WHERE asked IS NULL OR list_contains(answered, asked) OR (r <> 'tool' AND coalesce(text, '') <> '')""")
def tool_calls_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which every third message is a tool's answer, and some messages make a call."""
    t = F.col("turn")
    role = F.when(t % 3 == 1, "tool").otherwise(F.col("role"))
    calls = F.when((role != "tool") & (t % 2 == 0), F.array(F.concat(F.lit("c"), t))).otherwise(F.array().cast("array<string>"))
    answer = F.when((role == "tool") & (t % 4 > 0), F.concat(F.lit("c"), t - 1))
    m = table(spark, sf_dir, "conversations").filter("turn < 1000").select(F.col("conv_id").alias("conversation_id"), t.alias("seq"), role.alias("role"), F.col("text").alias("content"), calls.alias("call_ids"), answer.alias("call_id"))
    return M.without_orphan_calls(m).select("conversation_id", "seq", "role")


@query(f"WITH {A.MENTIONS_SQL}, a AS (SELECT pmid, count(*) AS k, arg_min(text, struct_pack(t := entity_type, s := l)) AS first FROM (SELECT *, row_number() OVER (PARTITION BY pmid, entity_type ORDER BY seq) AS l FROM m) GROUP BY 1) SELECT pmid, CASE WHEN k >= 2 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN k >= 2 THEN 'Entities: ' || first || ' (' END AS begins FROM a")
def relation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = A.mentions(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("pmid", "entity_type").orderBy("article_seq", "type_seq", F.col("m.entity_seq")))
    e = m.alias("m").select("pmid", "entity_type", seq.alias("entity_seq"), "text")
    p = N.relation_prompts(e, m.select("pmid").distinct().withColumn("text", F.lit("They interact.")))
    return p.select("pmid", "status", F.regexp_extract("prompt", r"^Entities: [^(]*\(", 0).alias("begins"))


@query("SELECT conv_id AS doc_id, string_agg(text, '|' ORDER BY turn) || '|' AS content, 'refine' AS strategy FROM conversations GROUP BY 1 HAVING NOT (sum(length(text)) <= 200 AND count(*) <= 3) UNION ALL SELECT conv_id, string_agg(text, '' ORDER BY turn), 'stuff' FROM conversations GROUP BY 1 HAVING sum(length(text)) <= 200 AND count(*) <= 3")
def refined_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return DOC.summarize(c, lambda parts: F.array_join(parts, ""), lambda summary, content: F.concat(summary, content, F.lit("|")), 200, use_refine=True)
