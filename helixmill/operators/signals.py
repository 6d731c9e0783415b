"""Signals between two snapshots, and consensus about a pair of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import scoring as S
from helixmill.functions.text import abstract_status
from helixmill.operators.graph import both_ways
from helixmill.session import cut

_KINDS = {"new_edge": "new_relation", "weight_increased": "growing_relation", "weight_decreased": "declining_relation", "disappeared_edge": "disappeared_relation"}


def compare_edges(new: DataFrame, old: DataFrame) -> DataFrame:
    """Every edge of either snapshot: (source_id, target_id, current_weight, previous_weight, num_sources, sources); edges
    that have n_sources instead of lists have no sources here either.

    Both sides are aggregated by their ordered pair in one shuffle; there is no join.
    """

    lists = "sources" in new.columns
    s = "sources" if lists else "n_sources"

    def side(edges: DataFrame, now: bool) -> DataFrame:
        w, zero = F.col("weight").cast("long"), F.lit(None).cast("long")
        return edges.select(
            F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), (w if now else zero).alias("c"), (zero if now else w).alias("p"), (F.col(s) if now else F.lit(None).cast(new.schema[s].dataType)).alias("s")
        )

    both = side(new, True).union(side(old, False)).groupBy("source_id", "target_id").agg(F.max("c").alias("c"), F.max("p").alias("p"), F.max("s").alias(s))
    n = F.size(F.coalesce("sources", F.array().cast("array<string>"))) if lists else F.coalesce("n_sources", F.lit(0))
    return both.select("source_id", "target_id", F.coalesce("c", F.lit(0)).alias("current_weight"), F.coalesce("p", F.lit(0)).alias("previous_weight"), n.alias("num_sources"), *["sources"] * lists)


def score_edges(compared: DataFrame) -> DataFrame:
    """Signal type, emergence score, class and relative change of compared edges."""
    c, p = F.col("current_weight"), F.col("previous_weight")
    kind = F.when((p == 0) & (c > 0), "new_relation").when(c == 0, "disappeared_relation").when(c > p, "growing_relation").when(c < p, "declining_relation").otherwise("existing_relation")
    scored = compared.withColumns({"signal_type": kind, "emergence_score": S.emergence(c, p, F.col("num_sources")), "velocity_pct": S.velocity_pct(c, p)})
    return scored.withColumn("classification", S.classify_signal(F.col("emergence_score")))


def broad_signals(new: DataFrame, old: DataFrame, limit: int = 20, include_disappeared: bool = False) -> DataFrame:
    """The highest scores: up to ``limit`` of each kind of change, then the first ``limit`` of all. Every edge is scored before any is cut."""
    kinds = ["new_relation", "growing_relation", "declining_relation"] + ["disappeared_relation"] * include_disappeared
    scored = score_edges(compare_edges(new, old)).filter(F.col("signal_type").isin(kinds))
    order = [F.desc("emergence_score"), F.asc("source_id"), F.asc("target_id")]
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("signal_type").orderBy(*order))).filter(F.col("k") <= limit).drop("k")
    if "sources" in best.columns:
        best = best.withColumn("pmids", F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, 20)).drop("sources")
    return best.orderBy(*order).limit(limit)


def matches(entity: str) -> Column:
    """Whether a node's id or label holds the entity, letter case aside."""
    e = entity.lower()
    return F.contains(F.lower("id"), F.lit(e)) | F.contains(F.lower("label"), F.lit(e))


def pair_signals(nodes: DataFrame, new: DataFrame, old: DataFrame, entity_a: str, entity_b: str) -> DataFrame:
    """Signals of the edges between nodes that match either entity; edges meet the two sets, their product is never built.

    Where no node matches either entity, the broad signals; where no edge joins them, one row "no_direct_edge".
    """
    hit = cut(nodes.filter(matches(entity_a) | matches(entity_b)).select("id", matches(entity_a).alias("a"), matches(entity_b).alias("b")))
    a, b = hit.filter("a").select("id"), hit.filter("b").select("id")
    if a.isEmpty() and b.isEmpty():
        return broad_signals(new, old)
    scored = score_edges(compare_edges(new, old)).filter("current_weight > 0")
    ends = both_ways(scored)
    found = ends.join(a, "id", "left_semi").join(b.withColumnRenamed("id", "neighbor"), "neighbor", "left_semi")
    found = found.select(F.col("id").alias("entity_a"), F.col("neighbor").alias("entity_b"), "signal_type", "classification", "current_weight", "previous_weight", "num_sources", "emergence_score", "velocity_pct")
    found = cut(found)
    if found.isEmpty():
        row = (entity_a, entity_b, "no_direct_edge", "NO_DATA", 0, 0, 0, 0.0, 0.0)
        return nodes.sparkSession.createDataFrame([row], found.schema)
    return found.orderBy(F.desc("emergence_score"), "entity_a", "entity_b")


def signal_groups(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), F.max("emergence_score").alias("top_score"))


def consensus(assertions: DataFrame, *keys: str) -> DataFrame:
    """Shares of each status (4 digits) and the label that follows; null and unknown statuses are PRESENT."""
    s = F.upper(F.coalesce("assertion_status", F.lit("PRESENT")))
    s = F.when(s.isin("NEGATED", "HYPOTHETICAL", "HISTORICAL"), s).otherwise("PRESENT")
    counted = assertions.withColumn("s", s).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("s") == x).alias(y) for x, y in (("PRESENT", "p"), ("NEGATED", "n"), ("HYPOTHETICAL", "h"), ("HISTORICAL", "o"))))

    def share(c: str) -> Column:
        return F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 4)).otherwise(0.0)

    out = counted.select(*keys, "total", share("p").alias("positive"), share("n").alias("negative"), share("h").alias("hypothetical"), share("o").alias("historical"))
    return out.withColumn("label", S.classify_consensus(F.col("positive"), F.col("negative"), F.col("hypothetical"), F.col("total")))


def assertions_of(pmids: DataFrame, stored: DataFrame, articles: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Stored assertions of the articles (of one entity, if named), or where there are none at all, by the words of each
    article's abstract; an article that isn't there counts as PRESENT."""
    known = stored.join(pmids.select("pmid").distinct(), "pmid", "left_semi")
    if entity_id is not None:
        known = known.filter(F.col("entity_id") == entity_id)
    if not known.isEmpty():
        return known.select("pmid", "assertion_status", "confidence")
    return pmids.select("pmid").join(articles.select("pmid", "abstract"), "pmid", "left").select("pmid", abstract_status(F.col("abstract")).alias("assertion_status"), F.lit(0.6).alias("confidence"))
