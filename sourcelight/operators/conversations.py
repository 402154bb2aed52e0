"""Conversations and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.functions.text import collapse_ws, is_blank, strip_ws
from sourcelight.operators.ordered import ordered_scan


def append_messages(
    conversations: DataFrame, messages: DataFrame, drafts: DataFrame, order: list[str], now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append drafts (conversation_id, role, content, citations and an order).

    Returns (new messages with ordinals, changed conversations, rejected drafts with a reason).
    """
    known = conversations.select("conversation_id").withColumn("__known", F.lit(True))
    reason = (
        F.when(is_blank("content") | (F.octet_length("content") > K.MAX_CONTENT_BYTES), "invalid_content")
        .when(~F.col("role").isin("user", "assistant"), "invalid_role")
        .when(F.size("citations") > K.MAX_MESSAGE_CITATIONS, "too_many_citations")
        .when(F.col("__known").isNull(), "not_found")
    )
    judged = drafts.join(known, "conversation_id", "left").withColumn("reason", reason).drop("__known")
    accepted = judged.filter("reason is null").drop("reason")
    top = messages.groupBy("conversation_id").agg((F.max("ordinal") + 1).alias("__base"))
    ranked = ordered_scan(accepted, ["conversation_id"], order, rank="__rn").join(top, "conversation_id", "left")
    ordinal = (F.coalesce("__base", F.lit(0)) + F.col("__rn") - 1).cast("bigint")
    added = ranked.withColumn("ordinal", ordinal).withColumn("content_sha256", F.sha2("content", 256)).drop("__base", "__rn")
    touched = accepted.select("conversation_id").distinct()
    changed = conversations.join(touched, "conversation_id", "left_semi").withColumn("updated_at", now)
    return added, changed, judged.filter("reason is not null")


def list_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), F.desc("conversation_id"))


def get_conversations(messages: DataFrame, objects: DataFrame) -> DataFrame:
    """Messages in order with their content from the object table.

    A payload that many messages share is one row of ``objects``, so a hot hash repeats on the message side
    only, which a skew join can split.
    """
    content = objects.select(F.col("sha256").alias("content_sha256"), F.col("payload").alias("content"))
    return messages.join(content, "content_sha256").orderBy("conversation_id", "ordinal")


def rename_conversations(conversations: DataFrame, renames: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply (conversation_id, title); returns (changed rows, rejected with a reason)."""
    title = strip_ws(F.col("new_title"))
    named = renames.select("conversation_id", F.col("title").alias("new_title")).join(
        conversations.withColumn("__known", F.lit(True)), "conversation_id", "left"
    )
    reason = F.when((title == "") | (F.octet_length(title) > K.MAX_TITLE_BYTES), "invalid_title").when(F.col("__known").isNull(), "not_found")
    judged = named.withColumn("reason", reason)
    changed = judged.filter("reason is null").withColumn("title", title).withColumn("updated_at", now)
    return changed.select(*conversations.columns), judged.filter("reason is not null").select("conversation_id", "reason")


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, objects: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete conversations with their messages and count their objects down, never below zero."""
    gone = removed.select("conversation_id").distinct()
    drops = messages.join(gone, "conversation_id", "left_semi").groupBy(F.col("content_sha256").alias("sha256")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    left = objects.join(drops, "sha256", "left").withColumn(
        "reference_count", F.greatest(F.lit(0), F.col("reference_count") - F.coalesce("__n", F.lit(0))).cast("bigint")
    ).drop("__n")
    return (
        conversations.join(gone, "conversation_id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
        left,
    )


def conversation_title(question) -> Column:
    return F.substring(collapse_ws(question), 1, K.TITLE_CHARS)
