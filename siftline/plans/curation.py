"""The curation plan: valid labels, signals, deduplication, coverage, allocation, gold, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.decisions import cell, is_valid
from siftline.functions.signals import band, difficulty, quality
from siftline.operators import select
from siftline.operators.contract import with_decision
from siftline.operators.dedup import deduplicate
from siftline.operators.evaluate import label_summary, top_errors
from siftline.scratch import stored


@dataclass
class Curated:
    """The tables of a run."""

    labels: DataFrame
    dedup: DataFrame
    cover: DataFrame
    train: DataFrame
    gold: DataFrame
    reports: dict[str, DataFrame]


def with_signals(rows: DataFrame) -> DataFrame:
    """Adds the typed label, validity, difficulty, quality, band and coverage cell.

    ``rows``: idx, id, scene, intent (of the seed), utterance, label (text), consistency, confidence, agreement
    (nullable), latency_ms.  Invalid rows have difficulty 1 and quality 0.
    """
    d = with_decision(rows, "label", name="decision")
    d = d.withColumn("valid", is_valid(F.col("decision"))).withColumn("errors", F.col("decision.errors"))
    hard = F.when(F.col("valid"), difficulty(F.col("consistency"), F.col("confidence"), F.col("agreement"))).otherwise(1.0)
    d = d.withColumn("difficulty", hard).withColumn("quality", quality(F.col("valid"), F.col("confidence"), F.col("agreement"))).withColumn("band", band(F.col("difficulty")))
    return d.withColumn("cell", cell(F.col("scene"), F.col("intent"), F.col("band"), F.col("decision.slots")))


def curate(rows: DataFrame, budget: int, gold_size: int, *, threshold: float = 0.8, seed: int = 42) -> Curated:
    """The whole plan over labelled rows.

    Deduplication and coverage see valid rows only; the pool is 1.35 times the budget; gold is drawn from rows that
    were kept but not selected, in the selection's proportions of scene and intent, filled up with invalid rows.
    """
    labels = stored(with_signals(rows))
    valid, invalid = labels.where("valid"), labels.where("not valid")
    dedup = stored(deduplicate(valid, text="utterance", priority=F.col("quality"), threshold=threshold))
    allowed = stored(valid.join(dedup.where("kept").select("idx"), "idx", "left_semi"))
    pool_size = min(allowed.count(), max(budget, int(select.POOL * budget)))
    cover = stored(select.greedy_cover(allowed, pool_size))
    pool = cover.drop("gain").withColumnRenamed("idx", "source_idx").withColumnRenamed("pick", "idx")
    train = stored(select.allocate(pool, min(budget, cover.count())))
    rest = allowed.join(train.select(F.col("source_idx").alias("idx")), "idx", "left_anti").withColumn("g_scene", F.col("decision.scene")).withColumn("g_intent", F.col("decision.intent"))
    shares = train.groupBy(F.col("decision.scene").alias("g_scene"), F.col("decision.intent").alias("g_intent")).agg(F.count("*").cast("double").alias("weight"))
    drawn = select.stratified(rest, min(gold_size, rest.count()), ["g_scene", "g_intent"], seed=seed, refill=True, weights=shares).drop("g_scene", "g_intent", "rank")
    gold = stored(select.top_up(drawn, invalid, gold_size))
    reports = {
        "labels": label_summary(labels),
        "errors": top_errors(invalid),
        "coverage": select.coverage_report(valid, cover),
        "objective": select.coverage_objective(cover),
        "baseline": select.random_baseline(valid, pool_size),
        "mix": select.mix_report(train),
    }
    return Curated(labels, dedup, cover, train, gold, reports)


def training_rows(train: DataFrame) -> DataFrame:
    """K1: what a training file holds."""
    return train.select("id", "scene", "intent", "utterance", F.col("label").alias("target"), "difficulty", "quality", F.struct("consistency", "confidence", "agreement").alias("signals"))


def gold_rows(gold: DataFrame) -> DataFrame:
    """What a gold file holds; the expected label is null for invalid rows."""
    return gold.select("id", "scene", "utterance", F.when(F.col("valid"), F.col("label")).alias("expected"), "difficulty")


def messages(train: DataFrame, template: str) -> DataFrame:
    """Two-message rows: the contract prompt and the target as text; scene and intent are the target's."""
    from siftline.functions.decisions import prompt

    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = prompt(F.coalesce(F.col("signals_text"), F.lit("")) if "signals_text" in train.columns else F.lit(""), F.col("utterance"), template)
    return train.select("id", F.col("decision.scene").alias("scene"), F.col("decision.intent").alias("intent"), F.array(m("user", asked), m("assistant", F.col("label"))).alias("messages"))
