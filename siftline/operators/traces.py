"""Request traces: statistics, stage shares, newest lists, chat shaping, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.signals import json_bytes


def trace_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Total, edge, cloud, failed, mean time of successes (null if none), share of the cloud (0 if empty)."""
    edge = F.col("executor") == "edge"
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count("*").alias("total"),
        F.count_if(edge).alias("edge"),
        F.count_if(~edge).alias("cloud"),
        F.count_if(~F.col("success")).alias("failed"),
        F.avg(F.when(F.col("success"), F.col("total_ms"))).alias("mean_ms"),
        F.when(F.count("*") > 0, F.count_if(~edge) / F.count("*")).otherwise(0.0).alias("cloud_share"),
    )


def stage_shares(rows: DataFrame, *, id_col: str = "id", stages: str = "stages") -> DataFrame:
    """Id, stage, ms, share of the trace's stages (their sum counts as 1 at least)."""
    flat = rows.select(F.col(id_col).alias("id"), F.explode(stages).alias("stage", "ms"))
    return flat.withColumn("share", F.col("ms") / F.greatest(F.lit(1), F.sum("ms").over(W.partitionBy("id"))))


def merged_stages(own: Column, more: Column) -> Column:
    """The union of two maps, the second one's values winning."""
    left = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(left, more)


def replaced(rows: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with the given columns taken from ``new`` where it has the key."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = rows.join(fresh, key, "left")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def of_group(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """rows whose scene belongs to a group, by a small dimension table (scene, scene_group)."""
    return rows.join(F.broadcast(groups.where(F.col("scene_group") == group)), "scene", "left_semi")


def current_sessions(rows: DataFrame, *, user: str = "user_id", session: str = "session_id") -> DataFrame:
    """ST4: rows of each user's latest session; results of older ones are dropped."""
    last = rows.groupBy(user).agg(F.max(session).alias(session))
    return rows.join(last, [user, session], "left_semi")


def fresh_cache(rows: DataFrame, now: Column, *, hours: int = 24, version: int = 4) -> DataFrame:
    """ST8: cached rows that are complete, of the current version and younger than the limit."""
    return rows.where((F.col("version") == version) & F.col("complete") & (now - F.col("cached_at") < F.expr(f"INTERVAL {hours} HOURS")))


def flattened(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, turns, dialogue: the non-blank turns as ``role：text`` lines in order; conversations without any are left out."""
    said = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.concat(F.coalesce("role", F.lit("")), F.lit("："), "text")
    lists = said.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line")))).alias("l"))
    return lists.select(conv, F.size("l").alias("turns"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("dialogue"))


def message_pairs(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A user turn and the assistant turn right after it, as a two-message conversation."""
    order = W.partitionBy(conv).orderBy(turn)
    nxt = turns.withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pairs = nxt.where((F.col("role") == "user") & (F.col("_role") == "assistant"))
    return pairs.select(F.format_string("%d-%d", conv, turn).alias("id"), F.array(message("user", F.col("text")), message("assistant", F.col("_text"))).alias("messages"))


def lengths(rows: DataFrame, length: Column) -> DataFrame:
    """Least, mean and largest length."""
    return rows.agg(F.min(length).alias("least"), F.avg(length).alias("mean"), F.max(length).alias("most"))


def pair_counts(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Distinct (a, b) pairs and distinct c."""
    return rows.agg(F.count_distinct(a, b).alias("pairs"), F.count_distinct(c).alias("values"))


def grouped_ids(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """Key, ids in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(idx)).alias("ids"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """A1, A2: keys, n, share of all rows, rounded to 4 places."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))  # over groups only


def response_meta(model: Column, latency_ms: Column, stages: Column, confidence: Column, reason: Column) -> Column:
    """The struct that describes how an answer was made."""
    return F.struct(model.alias("model"), latency_ms.alias("latency_ms"), stages.alias("stages"), F.round(confidence, 4).alias("confidence"), reason.alias("route_reason"))


def soft_label_stats(rows: DataFrame, soft: str = "soft_label", scale: int = 50_000) -> DataFrame:
    """A5: rows, mean bytes of the soft labels as JSON, all of them in MB, tokens, and GB for ``scale`` rows."""
    size = json_bytes(F.col(soft))
    out = rows.agg(F.count("*").alias("rows"), F.avg(size).alias("mean_bytes"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size(soft)), F.lit(0)).alias("tokens"))
    return out.select("rows", F.round("mean_bytes", 1).alias("mean_bytes"), F.round(F.col("bytes") / 1048576, 3).alias("megabytes"), "tokens", F.round(F.col("mean_bytes") * scale / 1073741824, 3).alias("gigabytes_at_scale"))
