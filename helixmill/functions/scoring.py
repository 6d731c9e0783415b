"""Scores as column expressions. Rounding is Spark's (half up on the decimal digits)."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def novelty(previous: Column) -> Column:
    return 100 * F.exp(-0.3 * F.greatest(previous, F.lit(0)))


def velocity(current: Column, previous: Column) -> Column:
    growth = (current - previous) / F.greatest(previous, F.lit(1))
    return F.when((current <= 0) | (growth <= 0), F.lit(0.0)).otherwise(100 * (1 - F.exp(-0.5 * growth)))


def diversity(sources: Column) -> Column:
    return F.when(sources <= 1, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 100 * F.ln(sources) / F.ln(F.lit(10.0))))


def impact(current: Column) -> Column:
    return F.when(current <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 100 * (1 - F.exp(-0.07 * current))))


def emergence(current: Column, previous: Column, sources: Column) -> Column:
    total = 0.3 * novelty(previous) + 0.3 * velocity(current, previous) + 0.2 * diversity(sources) + 0.2 * impact(current)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 2)


def classify_signal(score: Column) -> Column:
    return F.when(score >= 70, "EMERGING_SIGNAL").when(score >= 50, "ACCELERATING_TREND").when(score >= 30, "STABLE").otherwise("DECLINING")


def velocity_pct(current: Column, previous: Column, digits: int | None = 1) -> Column:
    value = (current - previous) / F.greatest(previous, F.lit(1)) * 100
    return value if digits is None else F.round(value, digits)


def classify_consensus(present: Column, negated: Column, hypothetical: Column, total: Column) -> Column:
    """By rounded proportions; the first rule that holds decides."""
    return (
        F.when(total == 0, "insufficient_data")
        .when(present > 0.8, "confirmed")
        .when(hypothetical > 0.5, "preliminary")
        .when((present >= 0.4) & (present <= 0.6), "contradictory")
        .when(negated > 0.5, "refuted")
        .otherwise("mixed")
    )


def consensus_label_display(present: Column, negated: Column, hypothetical: Column) -> Column:
    """The label a bar shows: of the three shares alone, and in another order than the stored one."""
    total = present + negated + hypothetical
    p, h = present / total, hypothetical / total
    return F.when(total == 0, "insufficient_data").when(p > 0.8, "confirmed").when((p >= 0.4) & (p <= 0.6), "contradictory").when(h > 0.5, "preliminary").otherwise("mixed")


def score_label(score: Column) -> Column:
    s = F.least(F.lit(100), F.greatest(F.lit(0), score))
    return F.when(s >= 80, "Strong").when(s >= 60, "Moderate").when(s >= 40, "Weak").otherwise("Very Weak")


def hybrid(vector_score: Column, graph_score: Column, weight: float = 0.3) -> Column:
    return F.coalesce(vector_score, F.lit(0.5)) * (1 - weight) + graph_score * weight


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets of lower-case strings; 0 if either is empty."""
    sets = F.struct(*(F.array_distinct(F.transform(c, F.lower)).alias(n) for n, c in (("x", a), ("y", b))))

    def share(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))

    # as an array's element the sets, and what makes them, are found once and not at each use
    return F.transform(F.array(sets), share)[0]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def node_size(frequency: Column) -> Column:
    """The drawn size of a node: grows with the root of its frequency, within bounds."""
    return clamp(F.sqrt(frequency) * 2, 4.0, 20.0)


def link_width(weight: Column) -> Column:
    return clamp(F.ln(weight + 1), 0.5, 6.0)


def retry_delay(attempt: int, initial: float = 1.0, base: float = 2.0, most: float = 60.0, chance: Callable[[], float] = random.random) -> float:
    """Seconds before a request is sent again: exponential up to a limit, half to one and a half times that."""
    return min(initial * base**attempt, most) * (0.5 + chance())


def least_interval(with_key: bool) -> float:
    """Seconds between requests to the literature service, with an access key or without."""
    return 1 / (9.5 if with_key else 2.8)
