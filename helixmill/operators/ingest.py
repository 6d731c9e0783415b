"""Ingestion: search, pages, entities, graph, snapshot; the loop of a job, which can be stopped and goes on, and of a topic.

The graph and the place that it was read up to are kept together in numbered versions of one folder: a version is there
as a whole or not at all, so that a job that is killed goes on from the last one with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import graph as G
from helixmill.operators import snapshots as SN
from helixmill.operators.jobs import MOST_ARTICLES
from helixmill.operators.ner import article_text
from helixmill.session import cut, newest, remove
from helixmill.sources import articles as SRC

#: Pages after which the graph is kept, and versions that stay.
PERSIST_EVERY, VERSIONS = 20, 2
Provider = Callable[[DataFrame], DataFrame]


def mentions_of(articles: DataFrame, provider: Provider, job_id: str, seq: str = "pmid") -> DataFrame:
    """What ``provider`` finds in articles (pmid, title, abstract), as mentions of a job; articles count in order of ``seq``."""
    texts = articles.select("pmid", article_text(F.col("title"), F.col("abstract")).alias("text"))
    found = provider(texts).join(articles.select("pmid", F.col(seq).alias("article_seq")).distinct(), "pmid")
    none = F.lit(None).cast("string")
    return found.select(
        "pmid", F.col("article_seq").cast("long").alias("article_seq"), F.dense_rank().over(G.Window.partitionBy("pmid").orderBy("entity_type")).alias("type_seq"), F.col("entity_seq").cast("long").alias("entity_seq"), "entity_type", "text", "confidence",
        none.alias("concept_id"), none.alias("concept_source"), none.alias("assertion_status"), F.lit(job_id).alias("job_id"),
    )


def _state(spark: SparkSession, folder: str) -> tuple[tuple[DataFrame, DataFrame] | None, int, int]:
    """The graph, the next place to read from and the number of batches so far, of the newest whole version."""
    last = newest(spark, folder, "state-")
    if last is None:
        return None, 0, 0
    at = spark.read.parquet(f"{folder}/state-{last}").first()
    return (spark.read.parquet(f"{folder}/nodes-{last}"), spark.read.parquet(f"{folder}/edges-{last}")), at.last_retstart, at.batches


def _keep(spark: SparkSession, folder: str, graph: tuple[DataFrame, DataFrame], at: int, batches: int) -> None:
    """The next version: nodes, edges, and last the state that makes it count; older ones go but for the one before."""
    last = newest(spark, folder, "state-")
    n = 0 if last is None else last + 1
    for name, df in zip(("nodes", "edges"), graph):
        df.write.mode("overwrite").parquet(f"{folder}/{name}-{n}")  # what a killed run left of this number goes
    spark.createDataFrame([(at, batches)], "last_retstart int, batches int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state-{n}")
    for name in ("state", "nodes", "edges"):
        if n >= VERSIONS:
            remove(spark, f"{folder}/{name}-{n - VERSIONS}")


def ingest(spark: SparkSession, transport, cursor: dict, provider: Provider, folder: str, job_id: str, mode: str = "full", batch_size: int = 500, max_batches: int | None = None, persist_every: int = PERSIST_EVERY, snapshot_folder: str | None = None) -> dict:
    """Read what a search found (``cursor``: web_env, query_key, count) page by page into the graph in ``folder``.

    At most ``MOST_ARTICLES`` unless only metadata is asked for; ``persist_every`` pages are fetched at a time, each by an
    executor, merged into the graph and kept with the place they reach; an empty page ends the job. Called again after a
    failure it goes on from there. Modes: full; metadata_only, where only articles are kept; deferred_ner, where articles are
    kept and ``entities_later`` makes the graph. Returns last_retstart, batches, status, and whether all was read.
    """
    total = int(cursor["count"]) if mode == "metadata_only" else min(int(cursor["count"]), MOST_ARTICLES)
    graph, at, batches = _state(spark, folder)
    todo = SRC.pages(total, batch_size, at, None if max_batches is None else max(0, max_batches - batches))
    for k in range(0, len(todo), persist_every):
        part = todo[k : k + persist_every]
        articles = cut(SRC.fetch_pages(spark, transport, cursor, part))
        if articles.isEmpty():
            break
        version = newest(spark, folder, "state-")
        articles.write.mode("overwrite").parquet(f"{folder}/articles/part-{0 if version is None else version + 1}")
        if mode == "full":
            mentions = mentions_of(articles, provider, job_id)
            new = G.build_graph(mentions, edge_mode="co_occurrence")
        else:
            new = G.build_graph(mentions_of(articles.limit(0), provider, job_id), edge_mode="co_occurrence")
        graph = new if graph is None else G.merge_graphs(graph, new)
        at, batches = part[-1][0] + part[-1][1], batches + len(part)
        _keep(spark, folder, graph, at, batches)
        graph, at, batches = _state(spark, folder)
    done = at >= total or (max_batches is not None and batches >= max_batches)
    if snapshot_folder is not None and graph is not None:
        SN.save(*graph, snapshot_folder, "job", job_id)
    return {"last_retstart": at, "batches": batches, "status": "completed", "whole": done}


def articles_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that a job has read, once each."""
    return spark.read.parquet(f"{folder}/articles/*").dropDuplicates(["pmid"])


def entities_later(spark: SparkSession, folder: str, provider: Provider, job_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a job of mode deferred_ner, from the articles it kept."""
    return G.build_graph(mentions_of(articles_so_far(spark, folder), provider, job_id), edge_mode="co_occurrence")


def run_topic(spark: SparkSession, transport, term: str, provider: Provider, graph: tuple[DataFrame, DataFrame] | None, snapshot_folder: str, label: str, job_id: str, max_results: int = 50) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """One run of a watched topic: search, entities, graph, weekly snapshot. Returns (log of steps (run_id, step, ok, error),
    graph); a step that fails ends the run, and the graph then stays as it was. ``jobs.run_status`` tells how it went."""
    log: list[tuple] = []
    new = None

    def step(name: str, run):
        if log and not log[-1][2]:
            return None
        try:
            out = run()
            log.append((job_id, name, True, None))
            return out
        except Exception as e:  # noqa: BLE001 - what a step meets is the log's business
            log.append((job_id, name, False, str(e)[:500]))
            return None

    ids = step("search", lambda: SRC.search_ids(transport, term, max_results))
    articles = step("fetch", lambda: cut(SRC.fetch_articles(spark, transport, ids)))
    mentions = step("entities", lambda: cut(mentions_of(articles, provider, job_id)))
    new = step("graph", lambda: tuple(cut(t) for t in (G.build_graph(mentions, edge_mode="co_occurrence") if graph is None else G.merge_graphs(graph, G.build_graph(mentions, edge_mode="co_occurrence")))))
    step("snapshot", lambda: SN.save(*new, snapshot_folder, "week", label))
    return spark.createDataFrame(log, "run_id string, step string, ok boolean, error string"), new or graph
