"""Weekly and per-job snapshots of the graph, and what changed between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.operators.graph import induced
from helixmill.session import cut, exists


def save(nodes: DataFrame, edges: DataFrame, folder: str, scope: str, label: str) -> None:
    """Write a snapshot; one of the same scope ("week" or "job") and label is replaced, others stay."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        tagged = df.withColumns({"scope": F.lit(scope), "snapshot": F.lit(label)})
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "snapshot").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, scope: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot; no rows if there is none of that label."""

    def part(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").filter((F.col("scope") == scope) & (F.col("snapshot") == label)).drop("scope", "snapshot")

    return part("nodes"), part("edges")


def load_first(spark: SparkSession, folders: tuple[str, ...], scope: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot from the first place that holds one of the label, such as a database before files; no rows if none does."""
    found = None
    for folder in folders:
        if exists(spark, f"{folder}/nodes"):
            found = load(spark, folder, scope, label)
            if not found[0].isEmpty():
                return found
    if found is None:
        raise FileNotFoundError(f"no snapshots in {', '.join(folders)}")
    return found


def labels(spark: SparkSession, *folders: str, scope: str = "week") -> DataFrame:
    """Labels of all places that hold snapshots, once each, in order."""
    out = None
    for f in folders:
        found = spark.read.parquet(f"{f}/nodes").filter(F.col("scope") == scope).select(F.col("snapshot").cast("string").alias("snapshot"))
        out = found if out is None else out.union(found)
    return out.distinct().orderBy("snapshot")


def latest_as_of(snapshots: DataFrame, week: str) -> DataFrame:
    """One row: the last label not after ``week``."""
    return snapshots.filter(F.col("snapshot") <= week).agg(F.max("snapshot").alias("snapshot"))


def default_pair(snapshots: DataFrame, back: int = 4) -> DataFrame:
    """(newest, older): the newest label and the one ``back`` places before, or the oldest there is."""
    ranked = snapshots.select("snapshot").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("snapshot"))))
    return ranked.filter(F.col("k") <= back + 1).agg(F.max("snapshot").alias("newest"), F.min("snapshot").alias("older"))


def job_snapshot(nodes: DataFrame, edges: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    """What a job contributed to."""
    kept = cut(nodes.filter(F.array_contains("job_ids", job_id)))
    return kept, induced(kept, edges.filter(F.array_contains("job_ids", job_id)))


def node_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, change): nodes that only one snapshot has; one pass over both."""
    both = new.select("id", F.lit(1).alias("n"), F.lit(0).alias("o")).union(old.select("id", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.max("n").alias("n"), F.max("o").alias("o")).filter("n + o = 1").select("id", F.when(F.col("n") == 1, "new_node").otherwise("disappeared_node").alias("change"))


def edge_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(source_id, target_id, change, old_weight, new_weight) of every edge that differs, whichever way its ends are written."""

    def ordered(edges: DataFrame, new_weight: Column, old_weight: Column) -> DataFrame:
        return edges.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), new_weight.alias("new_weight"), old_weight.alias("old_weight"))

    none = F.lit(None).cast("long")
    w = F.col("weight").cast("long")
    both = ordered(new, w, none).union(ordered(old, none, w)).groupBy("source_id", "target_id").agg(F.max("new_weight").alias("new_weight"), F.max("old_weight").alias("old_weight"))
    change = F.when(F.col("old_weight").isNull(), "new_edge").when(F.col("new_weight").isNull(), "disappeared_edge").when(F.col("new_weight") > F.col("old_weight"), "weight_increased").when(F.col("new_weight") < F.col("old_weight"), "weight_decreased")
    return both.withColumn("change", change).filter("change is not null").select("source_id", "target_id", "change", "old_weight", "new_weight")


def diff_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts from node_diff and edge_diff."""
    n = nodes.agg(F.count_if(F.col("change") == "new_node").alias("total_new_nodes"), F.count_if(F.col("change") == "disappeared_node").alias("total_disappeared_nodes"))
    e = edges.agg(F.count_if(F.col("change") == "new_edge").alias("total_new_edges"), F.count_if(F.col("change") == "disappeared_edge").alias("total_disappeared_edges"), F.count_if(F.col("change") == "weight_increased").alias("total_weight_increased"), F.count_if(F.col("change") == "weight_decreased").alias("total_weight_decreased"))
    return n.crossJoin(e)


def labelled_diff(diff: DataFrame, new: DataFrame, old: DataFrame, per_change: int = 50) -> DataFrame:
    """edge_diff with the labels and types of both ends, from either snapshot; the first ``per_change`` of each change."""
    ranked = diff.withColumn("k", F.row_number().over(Window.partitionBy("change").orderBy(F.desc(F.abs(F.coalesce("new_weight", F.lit(0)) - F.coalesce("old_weight", F.lit(0)))), "source_id", "target_id"))).filter(F.col("k") <= per_change)
    info = new.select("id", "label", "entity_type", F.lit(0).alias("age")).union(old.select("id", "label", "entity_type", F.lit(1))).groupBy("id").agg(F.min_by("label", "age").alias("label"), F.min_by("entity_type", "age").alias("entity_type"))
    for end in ("source", "target"):
        ranked = ranked.join(info.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("entity_type").alias(f"{end}_type")), f"{end}_id", "left")
    return ranked


def to_document(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """A snapshot as one JSON document. A document holds all of it: for graphs that fit one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.sort_array(F.collect_list(F.struct("id", *[c for c in nodes.columns if c != "id"]))).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.sort_array(F.collect_list(F.struct("source_id", "target_id", *[c for c in edges.columns if c not in ("source_id", "target_id")]))).alias("edges"))
    return n.crossJoin(e).select(F.lit(label).alias("snapshot"), F.to_json(F.struct(F.lit(label).alias("week_label"), "node_count", "edge_count", "nodes", "edges")).alias("document"))


def from_document(documents: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = documents.select(F.from_json("document", f"nodes array<{node_schema}>, edges array<{edge_schema}>").alias("d"))
    return parsed.select(F.inline("d.nodes")), parsed.select(F.inline("d.edges"))
