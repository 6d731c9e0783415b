"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_absent(values: Column, new: Column) -> Column:
    """``new`` at the end of an array that doesn't hold it; null and empty add nothing."""
    return F.when(new.isNull() | (new == "") | F.array_contains(values, new), values).otherwise(F.concat(values, F.array(new)))


def ordered_distinct(value: Column, ordinal: Column) -> Column:
    """Aggregate: distinct non-empty values in the order of their first ordinal."""
    pairs = F.sort_array(F.collect_set(F.when(value.isNotNull() & (value != ""), F.struct(ordinal.alias("o"), value.alias("v")))))
    return F.array_distinct(pairs["v"])


def distinct_lists(df: DataFrame, keys: list[str], ordinal: str, **values: str) -> DataFrame:
    """For each key and each named column its distinct non-empty values, in the order of their first ordinal.

    Values are made distinct by a hash aggregation before they are gathered, so that what repeats is combined where it is
    read, and no list holds a value twice.
    """
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(values.values())))
    rows = df.select(*keys, F.col(ordinal).alias("o"), F.explode(kinds).alias("x")).filter("x.v is not null and x.v <> ''")
    first = rows.groupBy(*keys, F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.min("o").alias("o"))
    return first.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("i") == i, F.struct("o", "v"))))["v"].alias(name) for i, name in enumerate(values)))


def explode_lists(df: DataFrame, lists: str, key: str = "entity_type", position: str = "entity_seq", value: str = "entity") -> DataFrame:
    """A map of lists as rows (key, position, value)."""
    rest = [c for c in df.columns if c != lists]
    return df.select(*rest, F.explode(lists).alias(key, "__list")).select(*rest, key, F.posexplode("__list").alias(position, value))


def entity_json(text: Column, confidence: Column, **optional: Column) -> Column:
    """A JSON object: text and confidence always, what else isn't null."""
    rest = F.to_json(F.struct(*(c.alias(n) for n, c in optional.items())), {"ignoreNullFields": "true"}) if optional else F.lit("{}")
    head = F.to_json(F.struct(text.alias("text"), confidence.alias("confidence")), {"ignoreNullFields": "false"})
    return F.when(rest == "{}", head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(rest, F.lit(2))))


def json_field_is(document: Column, field: str, value: str) -> Column:
    return F.get_json_object(document, f"$.{field}") == value


def merge_maps(base: Column, over: Column) -> Column:
    """Keys of ``over`` replace those of ``base``."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def first_joined(values: Column, n: int, separator: str = ", ") -> Column:
    return F.array_join(F.slice(values, 1, n), separator)


def concat_lists(value: Column, ordinal: Column) -> Column:
    """Aggregate: lists one after another, by ordinal."""
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(ordinal.alias("o"), value.alias("v")))), lambda x: x["v"]))
