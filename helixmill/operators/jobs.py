"""Bookkeeping of ingestion jobs, topics, watched topics and caches; every transition is a table in and a table out."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.dates import job_expiry, next_run

#: What a job may turn into.
TRANSITIONS = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled"), "failed": ("running",), "completed": (), "cancelled": ()}
MODES = ("full", "metadata_only", "deferred_ner")
MOST_ARTICLES = 10_000


def apply_transitions(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs (job_id, status) after events (job_id, seq, to_status), each applied in order if the state allows it then."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    steps = events.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "to_status"))), lambda x: x["to_status"]).alias("steps"))

    def step(state: Column, to: Column) -> Column:
        return F.when(F.array_contains(F.coalesce(F.try_element_at(allowed, state), F.array().cast("array<string>")), to), to).otherwise(state)

    final = F.when(F.col("steps").isNull(), F.col("status")).otherwise(F.aggregate("steps", F.col("status"), step))
    return jobs.join(steps, "job_id", "left").withColumn("status", final).drop("steps")


def progress(processed: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(processed / total * 100)


def can_resume(jobs: DataFrame) -> DataFrame:
    """Failed jobs whose cursor is known and isn't at the end."""
    return jobs.filter((F.col("status") == "failed") & F.col("web_env").isNotNull() & F.col("query_key").isNotNull() & (F.col("last_retstart") < F.col("total_articles")))


def plan_batches(jobs: DataFrame, max_batches: int | None = None) -> DataFrame:
    """(job_id, batch_no, retstart, retmax) of what a job has still to fetch: from its last place, in pages of its batch
    size, up to 10,000 articles unless only metadata is asked for."""
    cap = F.when(F.col("mode") == "metadata_only", F.col("total_articles")).otherwise(F.least("total_articles", F.lit(MOST_ARTICLES)))
    size = F.least(F.greatest(F.col("batch_size"), F.lit(1)), F.lit(500))
    start = F.coalesce("last_retstart", F.lit(0))
    pages = jobs.withColumns({"cap": cap, "size": size, "start": start}).filter("start < cap").select("job_id", "cap", "size", F.posexplode(F.expr("sequence(start, cap - 1, size)")).alias("batch_no", "retstart"))
    if max_batches is not None:
        pages = pages.filter(F.col("batch_no") < max_batches)
    return pages.select("job_id", "batch_no", "retstart", F.least("size", F.col("cap") - F.col("retstart")).alias("retmax"))


def by_status(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs (of a status): ordered first, then cut."""
    return (jobs if status is None else jobs.filter(F.col("status") == status)).orderBy(F.desc("created_at"), "job_id").limit(limit)


def live(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that haven't expired, with the time at which they do."""
    return jobs.withColumn("expires_at", job_expiry(F.col("updated_at"), F.col("status"))).filter(F.col("expires_at") > now)


def entity_count(results: DataFrame) -> DataFrame:
    """One row: entities over all results (entities: a map of lists)."""
    sizes = F.aggregate(F.map_values("entities"), F.lit(0), lambda s, x: s + F.greatest(F.size(x), F.lit(0)))
    return results.agg(F.coalesce(F.sum(sizes), F.lit(0)).alias("entities_extracted"))


# --- rows with soft deletion ---


def active(rows: DataFrame, user_id: Column | None = None, only_active: bool = False) -> DataFrame:
    out = rows.filter("deleted_at is null")
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    return (out.filter("is_active") if only_active else out).orderBy("created_at", "id")


def soft_delete(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("__hit")


def update(rows: DataFrame, changes: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Rows with the non-null columns of ``changes``; updated_at of changed rows becomes ``now``."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), *(F.col(c).alias(f"__new_{c}") for c in names), F.lit(True).alias("__hit"))
    out = rows.join(renamed, key, "left")
    values = {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in names}
    if "updated_at" in rows.columns:
        values["updated_at"] = F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))
    return out.withColumns(values).select(*rows.columns)


def insert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows and those of ``new`` whose key isn't there."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti").select(*rows.columns))


def invalid_topics(topics: DataFrame) -> DataFrame:
    """Topics that break the bounds: 1 to 100 results, queries of 3 to 500 characters."""
    return topics.filter(~F.coalesce(F.col("max_results").between(1, 100) & F.length("query").between(3, 500), F.lit(False)))


# --- topics ---


def new_articles(found: DataFrame, user_articles: DataFrame) -> DataFrame:
    """Found articles (user_id, pmid) that the user doesn't have."""
    return found.join(user_articles.select("user_id", "pmid"), ["user_id", "pmid"], "left_anti")


def run_search(topics: DataFrame, found: DataFrame, user_articles: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history rows, articles to add, topics with their new totals) of searches: found (topic_id, user_id, pmid)."""
    new = new_articles(found, user_articles).dropDuplicates(["user_id", "pmid"])
    fresh = new.groupBy("topic_id").agg(F.count(F.lit(1)).alias("new_articles"))
    history = found.groupBy("topic_id", "user_id").agg(F.count(F.lit(1)).alias("total_results"), F.sort_array(F.collect_set("pmid")).alias("pmids")).join(fresh, "topic_id", "left").na.fill(0, ["new_articles"]).withColumns({"executed_at": now, "status": F.lit("success")})
    ran = history.select("topic_id", "new_articles")
    totals = topics.join(ran, "topic_id", "left").withColumns({"total_articles_found": F.col("total_articles_found") + F.coalesce("new_articles", F.lit(0)), "last_search_at": F.when(F.col("new_articles").isNotNull(), now).otherwise(F.col("last_search_at"))}).drop("new_articles")
    return history, new, totals


def due(topics: DataFrame, now: Column) -> DataFrame:
    return topics.filter(F.col("is_active") & (F.col("next_run_at") <= now))


def after_run(topics: DataFrame, now: Column) -> DataFrame:
    """Due topics with the time they run next."""
    return due(topics, now).withColumns({"last_run_at": now, "next_run_at": next_run(now, F.col("frequency"))})


def run_status(steps: DataFrame) -> DataFrame:
    """success, partial or failed for each run, by its steps (run_id, ok)."""
    n, good = F.count(F.lit(1)), F.count_if(F.col("ok"))
    return steps.groupBy("run_id").agg(F.when(good == n, "success").when(good > 0, "partial").otherwise("failed").alias("status"))


def last_executions(executions: DataFrame, limit: int = 10) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("executed_at"), "id"))
    return executions.withColumn("k", k).filter(F.col("k") <= limit).drop("k")


def pick_pmids(text: Column, limit: int = 50) -> Column:
    """A list written with commas: trimmed, blanks left out, the first so many."""
    return F.slice(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, limit)


# --- caches ---


def cache_stats(requests: DataFrame, *by: str) -> DataFrame:
    """Hits, misses, rate in percent and distinct keys, of requests (key, hit): one row, or one for each of ``by``."""
    hits, n = F.count_if(F.col("hit")), F.count(F.lit(1))
    return requests.groupBy(*by).agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, F.round(hits / n * 100, 2)).otherwise(0.0).alias("hit_rate"), F.countDistinct("key").alias("size"))


def cache_after(entries: DataFrame, now: Column, ttl_seconds: int, max_size: int) -> DataFrame:
    """Entries (key, stored_at) that live on: not older than the limit, the newest ``max_size``."""
    fresh = entries.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp")) <= ttl_seconds * 1_000_000)
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("stored_at")))
    return fresh.withColumn("k", k).filter("k = 1").drop("k").orderBy(F.desc("stored_at"), "key").limit(max_size)


class RateLimiter:
    """At least so many seconds between calls."""

    def __init__(self, per_second: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self._clock, self._sleep, self._next = 1 / per_second, clock, sleep, 0.0

    def wait(self) -> float:
        now = self._clock()
        pause = max(0.0, self._next - now)
        if pause:
            self._sleep(pause)
        self._next = max(now, self._next) + self.interval
        return pause


def with_retries(call, attempts: int = 3, delay=None, sleep=time.sleep):
    """``call()``, again after a pause where it raises, the last error if it never ends well."""
    from helixmill.functions.scoring import retry_delay

    for i in range(attempts):
        try:
            return call()
        except OSError:
            if i == attempts - 1:
                raise
            sleep((delay or retry_delay)(i))
