"""Keyed tables on Parquet: upsert, lookup, and sinks. A write goes to a new version beside the old one and then becomes current."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.session import newest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows by key, those of ``new`` in place of the old; of several new rows of a key the last by ``order``, and of equal
    ones, or without an order, the greatest by its other columns as JSON: a table has no last row otherwise."""
    rest = F.to_json(F.struct(*sorted(c for c in new.columns if c not in keys)) if len(new.columns) > len(keys) else F.struct(F.lit(0)), {"ignoreNullFields": "false"})
    last = [] if order is None else [order.desc()]
    n = new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*last, rest.desc()))).filter("__k = 1").drop("__k")
    return old.join(n.select(*keys), keys, "left_anti").unionByName(n)


def upsert_articles(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """Articles by pmid; null texts and lists become empty, and an address is made where there is none."""
    filled = new.filter(F.coalesce("pmid", F.lit("")) != "")
    for c, t in new.dtypes:
        if c != "pmid" and t == "string":
            filled = filled.withColumn(c, F.coalesce(c, F.lit("")))
        elif t == "array<string>":
            filled = filled.withColumn(c, F.coalesce(c, F.array().cast(t)))
    if "pubmed_url" in new.columns:
        filled = filled.withColumn("pubmed_url", F.when(F.col("pubmed_url") == "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))).otherwise(F.col("pubmed_url")))
    return upsert(old, filled, ["pmid"], order)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by their ends in order."""
    ordered = new.withColumns({"source_id": F.least("source_id", "target_id"), "target_id": F.greatest("source_id", "target_id")})
    return upsert(old, ordered, ["source_id", "target_id"])


def write_version(df: DataFrame, folder: str) -> int:
    """Write the next version; readers of the one before aren't disturbed, and a write that fails leaves it current. Of two
    writers of one number the later fails."""
    last = newest(df.sparkSession, folder, "v-")
    version = 0 if last is None else last + 1
    df.write.parquet(f"{folder}/v-{version}")
    return version


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The version of the highest number that was written to its end."""
    last = newest(spark, folder, "v-")
    if last is None:
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/v-{last}")


def first_graph(spark: SparkSession, sources: Iterable[Callable[[], tuple[DataFrame, DataFrame]]], empty: tuple[str, str] = ("id string", "source_id string, target_id string")) -> tuple[DataFrame, DataFrame]:
    """The graph of the first source that can be read and has a node, without rows that lack an id; else an empty one."""
    for source in sources:
        try:
            nodes, edges = load_graph(*source())
            if not nodes.isEmpty():
                return nodes, edges
        except (AnalysisException, FileNotFoundError):  # a cache or table that isn't there
            continue
    return spark.createDataFrame([], empty[0]), spark.createDataFrame([], empty[1])


def load_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables without rows that lack an id."""
    return nodes.filter(F.coalesce("id", F.lit("")) != ""), edges.filter((F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != ""))


def articles_by_pmids(articles: DataFrame, pmids: DataFrame) -> DataFrame:
    """The articles asked for; the planner broadcasts the ids where they are few."""
    return articles.join(pmids.select("pmid").distinct(), "pmid", "left_semi")


def write_events(events: DataFrame, path: str) -> None:
    """Events as lines of JSON."""
    events.write.mode("append").json(path)


def store_objects(files: DataFrame, put: Callable[[str, bytes], str], fallback: Callable[[str, bytes], str]) -> DataFrame:
    """(name, address, error) of files (name, content): each is put where ``put`` (name, content) says, or where that fails
    by ``fallback``, which is noted. Both are called on executors, and may be called again for a task that is repeated."""

    def run(rows: Iterable[Row]) -> Iterable[tuple]:
        for r in rows:
            try:
                yield r.name, put(r.name, bytes(r.content)), None
            except OSError as e:
                yield r.name, fallback(r.name, bytes(r.content)), str(e)

    return files.select("name", "content").rdd.mapPartitions(run).toDF("name string, address string, error string")


def notify(events: DataFrame, post: Callable[[str], None], attempts: int = 3) -> DataFrame:
    """(event, status) after each event (as JSON) was posted by its executor: sent, or the error of the last attempt."""
    names = events.columns

    def run(rows: Iterable[Row]) -> Iterable[tuple]:
        from helixmill.operators.jobs import with_retries

        for r in rows:
            try:
                with_retries(lambda r=r: post(r.event), attempts)
                yield r.event, "sent"
            except OSError as e:
                yield r.event, str(e)

    return events.select(F.to_json(F.struct(*names)).alias("event")).rdd.mapPartitions(run).toDF("event string, status string")
