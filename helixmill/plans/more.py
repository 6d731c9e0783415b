"""More queries: scalar functions, annotation documents, bookkeeping, stores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import collections as C
from helixmill.functions import dates as D
from helixmill.functions import scoring as S
from helixmill.functions import text as T
from helixmill.operators import documents as DOC
from helixmill.operators import graph as G
from helixmill.operators import jobs as J
from helixmill.operators import memory as M
from helixmill.operators import ner as N
from helixmill.operators import retrieval as R
from helixmill.operators import snapshots as SN
from helixmill.plans import adapters as A
from helixmill.plans.queries import HUB, NOW, WITH_EDGES, WITH_GRAPH, WITH_NODES, query
from helixmill.session import remove, shared_dir, table
from helixmill.sources import articles as SRC
from helixmill.sources import store
from helixmill.streaming import graph_stream

# --- scores and scalar functions ---


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS c, l_linenumber * 3 - 3 AS p, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(100 * exp(-0.3 * greatest(p, 0)), 6) AS novelty, round(CASE WHEN c <= 0 OR c <= p THEN 0.0 ELSE 100 * (1 - exp(-0.5 * ((c - p) / greatest(p, 1)))) END, 6) AS velocity,
 round(CASE WHEN n <= 1 THEN 0.0 ELSE least(100.0, 100 * ln(n) / ln(10.0)) END, 6) AS diversity, round(CASE WHEN c <= 0 THEN 0.0 ELSE least(100.0, 100 * (1 - exp(-0.07 * c))) END, 6) AS impact, round((c - p) / greatest(p, 1) * 100, 1) AS velocity_pct,
 CASE WHEN c >= 80 THEN 'Strong' WHEN c >= 60 THEN 'Moderate' WHEN c >= 40 THEN 'Weak' ELSE 'Very Weak' END AS score_label, round(least(20.0, greatest(4.0, sqrt(c) * 2)), 6) AS node_size FROM s""")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, n = F.col("l_quantity").cast("long"), F.col("l_linenumber") * 3 - 3, F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(x, 6).alias(k) for k, x in (("novelty", S.novelty(p)), ("velocity", S.velocity(c, p)), ("diversity", S.diversity(n)), ("impact", S.impact(c)), ("node_size", S.node_size(c)))), S.velocity_pct(c, p).alias("velocity_pct"), S.score_label(c).alias("score_label"))


@query("""SELECT c_custkey, 'q' || c_custkey || ' AND ("Randomized Controlled Trial"[Publication Type] OR "Review"[Publication Type])' || CASE WHEN c_custkey % 2 = 0 THEN ' AND ("' || c_mktsegment || '"[Journal])' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' AND eng[Language]' ELSE '' END AS term FROM customer""")
def entrez_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    term = T.entrez_query_column(F.concat(F.lit("q"), k), F.array(F.lit("RCT"), F.lit("Review")), F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(none), F.when(k % 3 == 0, "eng").otherwise(""), none)
    return table(spark, sf_dir, "customer").select("c_custkey", term.alias("term"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'NEGATED' WHEN 'click' THEN 'HYPOTHETICAL' WHEN 'view' THEN 'HISTORICAL' ELSE 'PRESENT' END AS status FROM events")
def assertion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "Absent").when(F.col("event_type") == "click", "possible").when(F.col("event_type") == "view", "PAST").when(F.col("event_type") == "signup", "confirmed").otherwise("odd")
    return table(spark, sf_dir, "events").select("event_id", T.assertion_of_labels(F.array(F.lit("other"), label)).alias("status"))


@query("SELECT doc_id, md5(trim(replace(text, chr(0), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS sanitized FROM documents")
def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize_text(F.col("text"))).alias("sanitized"))


@query("SELECT event_id, 'ok' AS status, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) = 5 AS is_five FROM events")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", T.reply_status(reply).alias("status"), T.parse_model_json(reply, "k int")["k"].alias("k"), C.json_field_is(F.col("props"), "k", "5").alias("is_five"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS pub_date, CAST(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS DOUBLE) AS seconds, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 7 ELSE 1 END AS ttl_days FROM orders")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("running")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.pub_date(F.date_format(d, "yyyy"), F.date_format(d, "MMM")).alias("pub_date"), D.seconds_between(d, F.lit("2002-01-01").cast("timestamp")).alias("seconds"), D.job_ttl_days(status).alias("ttl_days"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(C.ordered_distinct(F.col("o_orderpriority"), F.col("o_orderkey")), ",").alias("priorities"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ',' || p_type ELSE p_brand END AS appended, '{\"text\":\"' || p_name || '\",\"confidence\":null,\"start\":' || p_size || '}' AS entity FROM part")
def array_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    appended = C.append_absent(F.array("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand")))
    entity = C.entity_json(F.col("p_name"), F.lit(None).cast("double"), start=F.col("p_size"), label=F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(appended, ",").alias("appended"), entity.alias("entity"))


# --- graph and snapshots ---


@query(f"{WITH_GRAPH} SELECT '{HUB}' AS id, x.neighbor, n.label, n.entity_type, x.weight, x.relation_type FROM (SELECT CASE WHEN source_id = '{HUB}' THEN target_id ELSE source_id END AS neighbor, weight, relation_type FROM e WHERE '{HUB}' IN (source_id, target_id)) x JOIN n ON n.id = x.neighbor")
def node_with_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_with_neighbors(A.node_table(spark, sf_dir, lists=False), A.edge_table(spark, sf_dir), HUB)


@query(f"{WITH_GRAPH}, r AS (SELECT id, row_number() OVER (ORDER BY frequency DESC, id) AS position FROM n), t AS (SELECT * FROM r WHERE position <= 12) SELECT least(a.position, b.position) AS i, greatest(a.position, b.position) AS j, weight FROM e JOIN t a ON a.id = source_id JOIN t b ON b.id = target_id")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    top = A.node_table(spark, sf_dir, lists=False).orderBy(F.desc("frequency"), "id").limit(12)
    top = top.select("id", F.row_number().over(Window.orderBy(F.desc("frequency"), "id")).alias("position"))
    return R.pair_relations(top, A.edge_table(spark, sf_dir)).select("i", "j", "weight")


@query(f"{WITH_EDGES} SELECT source_id, target_id, count(*) AS n_parallel FROM p GROUP BY 1, 2 HAVING count(DISTINCT relation) = 3")
def fully_related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edge_table(spark, sf_dir, by_relation=True)
    return e.groupBy("source_id", "target_id").agg(F.sum("weight").alias("n_parallel"), F.count("relation_type").alias("k")).filter("k = 3").drop("k")


def _kept(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return spark.read.parquet(at)


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a snapshot that was written twice (the second replaces the first), and one of another label.

    The graph is made once and kept as Parquet, since three snapshots are taken from it."""
    m = A.mentions(spark, sf_dir).filter(f"day < timestamp_ntz '{NOW}'")
    folder = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    nodes, edges = (_kept(spark, df, f"{folder}-{name}") for name, df in (("nodes", G.build_nodes(m)), ("edges", A.edge_table(spark, sf_dir, "2000-06-01", NOW, lists=True))))
    SN.save(nodes.limit(3), edges.limit(3), folder, "week", "2000-W26")
    SN.save(nodes.limit(2), edges.limit(2), folder, "week", "2000-W25")
    SN.save(nodes, edges, folder, "week", "2000-W26")
    for name in ("nodes", "edges"):
        remove(spark, f"{folder}-{name}")
    return folder


@query(f"{WITH_NODES} SELECT node_id AS id, count(*) AS frequency, count(DISTINCT pmid) AS n_sources, max(confidence) AS confidence_max FROM m WHERE day < TIMESTAMP '{NOW}' GROUP BY 1")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = SN.load(spark, _saved(spark, sf_dir), "week", "2000-W26")
    return n.select("id", "frequency", F.size("sources").alias("n_sources"), "confidence_max")


@query(f"WITH {A.MENTIONS_SQL},{A.edges_sql('2000-06-01', NOW)} SELECT source_id, target_id, weight, relation_type, n_sources FROM e")
def snapshot_round_trip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = SN.load(spark, _saved(spark, sf_dir), "week", "2000-W26")
    return e.select("source_id", "target_id", "weight", "relation_type", F.size("sources").alias("n_sources"))


@query("SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS snapshot FROM orders")
def snapshot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks of two stores, some in both, that hold an empty graph of each."""
    stores = [f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}" for _ in range(2)]
    weeks = table(spark, sf_dir, "orders").select(D.week_label(F.col("o_orderdate")).alias("snapshot"), "o_orderkey").withColumn("scope", F.lit("week"))
    for k, folder in enumerate(stores):
        weeks.filter(F.col("o_orderkey") % 3 != k).write.partitionBy("scope", "snapshot").parquet(f"{folder}/nodes")
    return SN.labels(spark, *stores)


# --- entities and relations ---


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below 300 as annotation documents in JSON: parts are annotations; relations name two of them, by identifier, id or reference."""
    m = A.mentions(spark, sf_dir)
    kind = F.when(F.col("entity_type") == "PROMO", "Gene").when(F.col("entity_type") == "SMALL", "Disease").when(F.col("entity_type") == "LARGE", "Chemical").otherwise("Odd")
    a = F.struct(F.struct("type_seq", "entity_seq").alias("o"), F.struct(F.col("entity_seq").cast("string").alias("id"), F.when(F.col("type_seq") % 2 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"), F.struct(kind.alias("type"), F.concat(F.lit("X:"), F.col("entity_seq") % 100_000).alias("identifier")).alias("infons"), F.array(F.struct(F.lit(3).alias("offset"), F.length("text").alias("length"))).alias("locations")).alias("v"))
    docs = m.groupBy("pmid").agg(F.transform(F.sort_array(F.collect_list(a)), lambda x: x["v"]).alias("annotations"))
    first, last = F.col("annotations")[0]["id"], F.element_at("annotations", -1)["id"]
    relation = F.struct(F.struct(F.lit("Bind").alias("type"), first.alias("entity1"), last.alias("entity2")).alias("infons"))
    return docs.select(F.to_json(F.struct(F.array(F.struct(F.concat("pmid", F.lit("|None")).alias("_id"), F.array(F.struct("annotations")).alias("passages"), F.array(relation).alias("relations"))).alias("PubTator3"))).alias("json"))


_ANNOTATED = f"""WITH {A.MENTIONS_SQL}, a AS (SELECT pmid, CASE entity_type WHEN 'PROMO' THEN 'GENE' WHEN 'SMALL' THEN 'DISEASE' WHEN 'LARGE' THEN 'DRUG' END AS entity_type, CASE WHEN type_seq % 2 = 0 THEN upper(text) ELSE text END AS text, entity_seq, seq FROM m)"""


@query(f"{_ANNOTATED}, k AS (SELECT *, row_number() OVER (PARTITION BY pmid, entity_type, lower(text) ORDER BY seq) AS k FROM a WHERE entity_type IS NOT NULL) SELECT pmid, entity_type, text, 3 AS start, CAST(3 + length(text) AS INTEGER) AS \"end\", 'X:' || (entity_seq % 100000) AS concept_id FROM k WHERE k = 1")
def annotation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.document_entities(SRC.annotations_of(_documents(spark, sf_dir))).select("pmid", "entity_type", "text", "start", "end", "concept_id")


@query(f"{_ANNOTATED}, r AS (SELECT pmid, arg_min(text, seq) AS subject, arg_max(text, seq) AS object FROM a GROUP BY 1) SELECT pmid, subject, 'binds' AS relation, object FROM r WHERE lower(subject) <> lower(object)")
def annotation_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.document_relations(SRC.annotations_of(_documents(spark, sf_dir))).select("pmid", "subject", "relation", "object")


@query(f"WITH {A.MENTIONS_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.article_seq = o_orderkey AND entity_type IN ('PROMO', 'SMALL', 'LARGE')) THEN 'no annotations available' END AS error FROM orders")
def missing_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderkey").alias("position"))
    return N.fill_missing(asked, N.document_entities(SRC.annotations_of(_documents(spark, sf_dir)))).select("pmid", "error")


@query(f"WITH {A.MENTIONS_SQL} SELECT CASE flag WHEN 'A' THEN 'activates' ELSE 'located_in' END AS relation, count(*) AS n FROM m WHERE flag <> 'R' GROUP BY 1")
def known_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("flag") == "A", " Activates").when(F.col("flag") == "N", "Located In").otherwise("Upregulates")
    t = A.mentions(spark, sf_dir).select(F.col("text").alias("subject"), named.alias("relation"), F.col("job_id").alias("object"))
    return N.known_relations(t)[0].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.MENTIONS_SQL} SELECT 'upregulates' AS relation, count(*) AS n FROM m WHERE flag = 'R'")
def rejected_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("flag") == "A", " Activates").when(F.col("flag") == "N", "Located In").otherwise("Upregulates")
    t = A.mentions(spark, sf_dir).select(F.col("text").alias("subject"), named.alias("relation"), F.col("job_id").alias("object"))
    return N.known_relations(t)[1]


@query(f"WITH {A.MENTIONS_SQL} SELECT pmid, count(*) AS n FROM m WHERE confidence >= 0.95 AND flag <> 'N' GROUP BY 1")
def accepted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.mentions(spark, sf_dir).select("pmid", F.when(F.col("flag") == "N", "NO_RELATION").otherwise("treats").alias("relation"), "confidence")
    return N.accept_relations(p, 0.95).groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))


def _relation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and the priorities of their orders; parts of some types have no annotation."""
    m = A.mentions(spark, sf_dir)
    t = m.select(F.concat(F.lit(" "), "text").alias("subject"), F.lit("treats").alias("relation"), F.col("job_id").alias("object"))
    return G.relation_graph(t, m.filter("entity_type <> 'ECONOMY'"))


@query(f"WITH {A.MENTIONS_SQL}, e AS (SELECT DISTINCT trim(text) AS text FROM m UNION SELECT DISTINCT job_id FROM m), k AS (SELECT lower(trim(text)) AS key, arg_min(entity_type, seq) AS entity_type FROM m WHERE entity_type <> 'ECONOMY' GROUP BY 1) SELECT e.text, coalesce(k.entity_type, 'UNKNOWN') AS entity_type FROM e LEFT JOIN k ON k.key = lower(e.text)")
def relation_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation_graph(spark, sf_dir)[0].select("text", "entity_type")


@query(f"WITH {A.MENTIONS_SQL} SELECT trim(text) AS source, job_id AS target, 'treats' AS relation, count(*) AS n FROM m GROUP BY 1, 2")
def relation_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation_graph(spark, sf_dir)[1].groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


# --- documents ---


@query("WITH h AS (SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, min(length(trim(text))) AS n FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1) SELECT doc_id, file_hash FROM h WHERE n > 0")
def new_documents_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seen = d.filter("doc_id % 10 = 0").select(T.content_hash(F.col("text")).alias("file_hash"))
    return DOC.index_documents(d, seen).select("doc_id", "file_hash").distinct()


@query("SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY 1")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return DOC.tree_reduce(c, lambda parts: F.array_join(parts, ""), 3)


@query("SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return DOC.number_chunks(c, "turn")


@query("SELECT conv_id AS doc_id, count(*) AS n_pages FROM conversations GROUP BY 1")
def better_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").alias("content"))
    fewer = p.filter("page_no % 2 = 0")
    return DOC.better_loader(fewer, p).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(replace(trim(url), '0', 'O'), '|', 'I'), '\\s+', ' ', 'g'), '([0-9]) ?\\. ', '\\1. ', 'g') AS content FROM (SELECT page_id, CASE WHEN length(trim(url)) > 45 THEN 'no ' || page_id || '1 .   ' || url || ' |f  end' ELSE 'short ' END AS url FROM pages) WHERE length(trim(url)) > 20")
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.length(F.trim("url")) > 45, F.concat(F.lit("\tno "), "page_id", F.lit("1 .   "), "url", F.lit(" |f  end\n"))).otherwise(" short ")
    return DOC.clean_pages(table(spark, sf_dir, "pages").select("page_id", shown.alias("content"))).select("page_id", "content")


@query("SELECT query_id, string_agg('[Source ' || rank || ': d' || id || ']' || chr(10) || 'label ' || label || chr(10) || CASE WHEN id % 3 > 0 THEN 'Entities: ' || array_to_string(list_slice(['e' || id, 'x', 'y', 'z'], 1, 3), ', ') || chr(10) ELSE '' END || 'Relations: ' || rank, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT vec_id % 50 AS query_id, vec_id AS id, label, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS rank FROM embeddings) GROUP BY 1")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.concat(F.lit("d"), "vec_id").alias("name"), F.concat(F.lit("label "), "label").alias("content"), F.when(F.col("vec_id") % 3 > 0, F.array(F.concat(F.lit("e"), "vec_id"), F.lit("x"), F.lit("y"), F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("entities"), F.row_number().over(Window.partitionBy(F.col("vec_id") % 50).orderBy("vec_id")).alias("rank"))
    return R.format_context(v.withColumn("n_relations", F.col("rank")))


# --- bookkeeping ---


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).cast("timestamp").alias("next_run_at"), F.when(F.col("c_custkey") % 2 == 0, "weekly").otherwise("monthly").alias("frequency"), "c_mktsegment")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-14' ELSE TIMESTAMP '2024-02-01' END AS next_run_at FROM customer WHERE c_acctbal > 0 AND c_custkey % 30 <= 9")
def due_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.after_run(_topics(spark, sf_dir), F.lit("2024-01-10").cast("timestamp")).select("id", "next_run_at")


@query("""WITH f AS (SELECT o_custkey AS topic_id, l_partkey AS pmid, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT * FROM f WHERE d >= TIMESTAMP '2000-06-01'), h AS (SELECT DISTINCT topic_id, pmid FROM f WHERE d < TIMESTAMP '2000-06-01')
SELECT n.topic_id, count(*) AS total_results, count(DISTINCT CASE WHEN h.pmid IS NULL THEN n.pmid END) AS new_articles FROM n LEFT JOIN h ON h.topic_id = n.topic_id AND h.pmid = n.pmid GROUP BY 1""")
def topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("topic_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("pmid"), "o_orderdate")
    topics = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic_id"), F.lit(0).alias("total_articles_found"), F.lit(None).cast("timestamp").alias("last_search_at"))
    history, _, _ = J.run_search(topics, f.filter("o_orderdate >= timestamp_ntz '2000-06-01'"), f.filter("o_orderdate < timestamp_ntz '2000-06-01'"), F.lit("2001-01-01").cast("timestamp"))
    return history.select("topic_id", "total_results", "new_articles")


@query("SELECT l_orderkey AS run_id, CASE WHEN count_if(l_returnflag <> 'R') = count(*) THEN 'success' WHEN count_if(l_returnflag <> 'R') > 0 THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY 1")
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_status(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") != "R").alias("ok")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 200 NOT BETWEEN 1 AND 100 OR length(c_mktsegment) < 9")
def invalid_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).alias("max_results"), F.when(F.length("c_mktsegment") >= 9, F.col("c_mktsegment")).otherwise("x").alias("query"))
    return J.invalid_topics(t).select("id")


@query("WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' WHEN 'view' THEN 'running' ELSE 'pending' END AS s FROM events), r(user_id, n, st) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'pending' FROM e UNION ALL SELECT r.user_id, e.n, CASE WHEN (st = 'pending' AND s IN ('running', 'cancelled')) OR (st = 'running' AND s IN ('completed', 'failed', 'cancelled')) OR (st = 'failed' AND s = 'running') THEN s ELSE st END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id AS job_id, arg_max(st, n) AS status FROM r GROUP BY 1")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "cancelled").when(F.col("event_type") == "view", "running").otherwise("pending")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), to.alias("to_status"))
    return J.apply_transitions(e.select("job_id").distinct().withColumn("status", F.lit("pending")), e)


@query("SELECT c_custkey AS id, c_acctbal < 0 AS deleted, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_name END AS name FROM customer UNION ALL SELECT 1000000 + n_nationkey, false, n_name FROM nation")
def rows_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a soft deletion, an update and an insertion."""
    now, c = F.lit("2024-01-01").cast("timestamp"), table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    rows = J.soft_delete(rows, c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")), now)
    rows = J.update(rows, c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit("changed").alias("name")), now)
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    return J.insert(rows, new).select("id", F.col("deleted_at").isNotNull().alias("deleted"), "name")


@query("WITH f AS (SELECT user_id, max(ts) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1) SELECT user_id AS key FROM f ORDER BY t DESC, user_id LIMIT 40")
def cache_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("ts <= timestamp_ntz '2024-01-30 12:00:00'").select(F.col("user_id").alias("key"), F.col("ts").alias("stored_at"))
    return J.cache_after(e, F.lit("2024-01-30 12:00:00").cast("timestamp"), 86_400, 40).select("key")


@query("SELECT conv_id AS conversation_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4")
def messages_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of each conversation appended to the first, four messages kept."""
    m = A.messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return M.append(m.filter("created_at % 2 = 0"), m, 4).select("conversation_id", F.col("created_at").alias("turn"))


@query(f"WITH {A.MENTIONS_SQL} SELECT count(*) AS entities_extracted FROM m")
def entities_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mentions(spark, sf_dir)
    lists = m.groupBy("pmid", "entity_type").agg(F.collect_list("text").alias("l")).groupBy("pmid").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "l"))).alias("entities"))
    return J.entity_count(lists)


# --- stores and streams ---


@query(f"{WITH_EDGES}, h AS (SELECT * FROM e WHERE weight % 2 = 0) SELECT source_id, target_id, CASE WHEN weight % 2 = 0 THEN -1 ELSE weight END AS weight FROM e")
def edges_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edge_table(spark, sf_dir).select("source_id", "target_id", "weight")
    turned = e.filter("weight % 2 = 0").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(-1).cast("long").alias("weight"))
    return store.upsert_edges(e, turned)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written twice to the shared folder; the second version is current."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    store.write_version(o, folder)
    store.write_version(o.filter("o_orderkey % 2 = 0"), folder)
    return store.read_current(spark, folder)


@query(f"{WITH_NODES} SELECT node_id AS id, count(*) AS frequency, max(confidence) AS confidence_max, count(DISTINCT pmid) AS n_sources FROM m GROUP BY 1")
def streamed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as a stream of files, merged by micro-batch, and once more, which changes nothing."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    m = A.mentions(spark, sf_dir).drop("day", "flag")
    m.withColumn("part", F.col("article_seq") % 3).write.partitionBy("part").parquet(f"{folder}/in")
    for _ in range(2):
        graph_stream.merge_batches(graph_stream.mention_stream(spark, f"{folder}/in", m.schema, 100), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return graph_stream.current_nodes(spark, f"{folder}/out").select("id", "frequency", "confidence_max", F.size("sources").alias("n_sources"))
