"""Conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant")


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin(*ROLES))


def history_first(messages: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest messages of each conversation; the limit lies between 1 and 200."""
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "message_id"))
    return messages.withColumn("k", k).filter(F.col("k") <= max(1, min(limit, 200))).drop("k")


def history_last(messages: DataFrame, limit: int = 50) -> DataFrame:
    """The newest messages of each conversation."""
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    return messages.withColumn("k", k).filter(F.col("k") <= limit).drop("k")


def append(messages: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """New messages of known roles after the old ones; a message_id that is there already is replaced; the last ``keep`` stay."""
    both = messages.withColumn("__new", F.lit(0)).unionByName(valid_messages(new).withColumn("__new", F.lit(1)))
    k = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc("__new"), F.desc("created_at")))
    return history_last(both.withColumn("k", k).filter("k = 1").drop("k", "__new"), keep)


def conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, n_messages, last_message): the last cut to 100 characters."""
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"), F.substring(F.max_by("content", F.struct("created_at", "message_id")), 1, 100).alias("last_message"))


def stats(messages: DataFrame) -> DataFrame:
    """One row: conversations, messages, mean of messages a conversation."""
    per = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_messages"), F.coalesce(F.round(F.avg("n"), 4), F.lit(0.0)).alias("mean_messages"))


def cleanup(messages: DataFrame, keep: int = 100) -> DataFrame:
    """Messages of the conversations that have the most, ``keep`` of them."""
    most = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "conversation_id").limit(keep)
    return messages.join(most.select("conversation_id"), "conversation_id", "left_semi")


def without_orphan_calls(messages: DataFrame) -> DataFrame:
    """Messages in order (conversation_id, seq, role, content, call_ids[], call_id) without tool calls that lack an answer.

    Answers (role "tool") belong to the message before them. Where some call of a message has no answer, its calls and
    the answers go; its text stays if it has one. Answers without a call before them stay.
    """
    by = Window.partitionBy("conversation_id").orderBy("seq")
    block = F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(by)
    m = messages.withColumn("__block", block)
    group = Window.partitionBy("conversation_id", "__block")
    none = F.array().cast("array<string>")
    asked = F.coalesce(F.first(F.when(F.col("role") != "tool", F.coalesce("call_ids", none)), ignorenulls=True).over(group), none)
    answered = F.collect_set(F.when(F.col("role") == "tool", F.col("call_id"))).over(group)
    m = m.withColumns({"__asked": asked, "__answered": answered}).withColumn("__orphan", (F.size("__asked") > 0) & (F.size(F.array_except("__asked", "__answered")) > 0))
    kept = m.filter(~F.col("__orphan") | ((F.col("role") != "tool") & (F.coalesce("content", F.lit("")) != "")))
    return kept.withColumn("call_ids", F.when(F.col("__orphan"), none).otherwise(F.col("call_ids"))).drop("__block", "__asked", "__answered", "__orphan")
