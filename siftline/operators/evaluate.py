"""Model predictions against gold decisions, with a lenient and a strict denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.decisions import error_kind, is_valid
from siftline.operators.contract import with_decision

#: Passing rates, by whether a family asks that nothing be done.
TARGET_NEGATIVE, TARGET_OTHER = 0.95, 0.90


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def judged(gold: DataFrame, predictions: DataFrame, *, mode: str = "salvage") -> DataFrame:
    """Gold (id, expected as JSON, …) with ``want`` and ``got`` as typed decisions; missing predictions are null."""
    joined = gold.join(predictions.select("id", F.col("text").alias("_text")), "id", "left")
    return with_decision(with_decision(joined, "expected", name="want"), "_text", name="got", mode=mode).drop("_text")


def lenient(rows: DataFrame) -> DataFrame:
    """One row of metrics over :func:`judged` rows; accuracies are over valid predictions only.

    Slot pairs of predictions that are not valid count as missed.  Rates are rounded to 4 places.
    """
    ok = is_valid(F.col("got"))
    none = F.array().cast("array<string>")
    want, got = F.coalesce(F.col("want.pairs"), none), F.when(ok, F.col("got.pairs")).otherwise(none)
    keys = F.array_union(F.map_keys("want.slots"), F.map_keys("got.slots"))
    same = F.filter(keys, lambda k: F.element_at("want.slots", k).eqNullSafe(F.element_at("got.slots", k)))
    scene = ok & F.col("got.scene").eqNullSafe(F.col("want.scene"))
    intent = ok & F.col("got.intent").eqNullSafe(F.col("want.intent"))
    c = lambda x: F.coalesce(F.sum(x), F.lit(0))
    s = rows.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("valid"),
        F.count_if(scene).alias("scene"),
        F.count_if(intent).alias("intent"),
        F.count_if(ok & F.col("got.need_cloud").eqNullSafe(F.col("want.need_cloud"))).alias("cloud"),
        F.avg(F.when(ok, F.abs(F.col("got.complexity") - F.coalesce(F.col("want.complexity"), F.lit(0.0))))).alias("mae"),
        c(F.size(F.array_intersect(want, got))).alias("tp"),
        c(F.size(F.array_except(got, want))).alias("fp"),
        c(F.size(F.array_except(want, got))).alias("fn"),
        c(F.when(ok, F.size(keys))).alias("fields"),
        c(F.when(ok, F.size(same))).alias("fields_ok"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    r = lambda x: F.round(x, 4)
    return s.select(
        "total",
        F.col("valid").alias("contract_valid"),
        r(ratio(F.col("valid"), F.col("total"))).alias("contract_valid_rate"),
        r(ratio(F.col("scene"), F.col("valid"))).alias("scene_accuracy"),
        r(ratio(F.col("intent"), F.col("valid"))).alias("intent_accuracy"),
        r(ratio(F.col("cloud"), F.col("valid"))).alias("need_cloud_accuracy"),
        r(F.col("mae")).alias("complexity_mae"),
        r(precision).alias("slot_precision"),
        r(recall).alias("slot_recall"),
        r(ratio(2 * precision * recall, precision + recall)).alias("slot_f1"),
        r(ratio(F.col("fields_ok"), F.col("fields"))).alias("slot_field_accuracy"),
    )


def lenient_by_scene(rows: DataFrame) -> DataFrame:
    """Scene, n, accuracy (scene and intent right) over valid predictions."""
    right = F.col("got.scene").eqNullSafe(F.col("want.scene")) & F.col("got.intent").eqNullSafe(F.col("want.intent"))
    valid = rows.where(is_valid(F.col("got")))
    return valid.groupBy(F.coalesce("want.scene", F.lit("None")).alias("scene")).agg(F.count("*").alias("n"), F.round(F.count_if(right) / F.count("*"), 4).alias("accuracy"))


def failure_kinds(rows: DataFrame) -> DataFrame:
    """Kind, n of the first violation of each invalid prediction."""
    bad = rows.where(~is_valid(F.col("got")))
    kind = F.when(~F.col("got.is_object"), "unparsed").otherwise(error_kind(F.get("got.errors", F.lit(0))))
    return bad.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def field_right(name: str) -> Column:
    """Whether a field, or ``slots.name``, of the prediction equals the expected one."""
    if name.startswith("slots."):
        key = F.lit(name.split(".", 1)[1])
        return F.element_at("got.slots", key).eqNullSafe(F.element_at("want.slots", key)) & F.array_contains(F.map_keys("got.slots"), key)
    return F.col(f"got.{name}").eqNullSafe(F.col(f"want.{name}"))


def strict_rows(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds ``passed`` and ``wrong`` to strictly judged rows; ``checks`` lists the fields that must be right.

    A prediction counts only if the whole text is one JSON object that keeps the contract.
    """
    ok = F.col("got.is_object") & is_valid(F.col("got"))
    table = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(field_right(f), F.lit(False)))])
    wrong = F.filter("checks", lambda f: ~F.coalesce(F.element_at(table, f), F.lit(False)))
    marked = rows.withColumn("wrong", wrong).withColumn("passed", ok & (F.size("wrong") == 0)).withColumn("valid", ok)
    return marked.withColumn("wrong", F.when(~ok, F.concat(F.array(F.concat(F.lit("contract:"), F.array_join(F.slice("got.errors", 1, 2), ";"))), F.col("wrong"))).otherwise(F.col("wrong")))


def strict_fields(rows: DataFrame) -> DataFrame:
    """Field, correct, total, rate over all rows that label the field, valid or not."""
    counts = []
    for f in ("scene", "intent", "need_cloud"):
        labelled = F.col(f"want.{f}").isNotNull()
        counts.append((f, F.count_if(labelled & F.col("valid") & field_right(f)), F.count_if(labelled)))
    right = F.size(F.filter(F.map_entries("want.slots"), lambda e: F.element_at("got.slots", e["key"]).eqNullSafe(e["value"])))
    c = lambda x: F.coalesce(F.sum(x), F.lit(0))
    counts.append(("labeled_slots", c(F.when(F.col("valid"), right).otherwise(0)), c(F.size(F.map_keys("want.slots")))))
    one = rows.agg(F.array(*[F.struct(F.lit(f).alias("field"), right.alias("correct"), total.alias("total")) for f, right, total in counts]).alias("x"))  # one pass for all fields
    return one.select(F.inline("x")).withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")), 4))


def strict_families(rows: DataFrame, negative: tuple[str, ...]) -> DataFrame:
    """Family, correct, total, rate, target, passed."""
    target = F.when(F.col("family").isin(*negative), TARGET_NEGATIVE).otherwise(TARGET_OTHER)
    out = rows.groupBy("family").agg(F.count_if("passed").alias("correct"), F.count("*").alias("total"))
    return out.select("family", "correct", "total", F.round(F.col("correct") / F.col("total"), 4).alias("rate"), target.alias("target"), (F.col("correct") / F.col("total") >= target).alias("passed"))


def markdown(title: str, metrics: dict) -> str:
    """K5-K7: a report of one row of metrics."""
    lines = [f"# {title}", "", "| metric | value |", "| --- | ---: |"]
    return "\n".join(lines + [f"| {k} | {'—' if v is None else v} |" for k, v in metrics.items()]) + "\n"


def label_summary(rows: DataFrame) -> DataFrame:
    """A3: total, valid, invalid, rate, mean latency, number of rows with each signal."""
    signals = [c for c in ("consistency", "confidence", "agreement") if c in rows.columns]
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.round(ratio(F.count_if("valid"), F.count("*")), 4).alias("valid_rate"),
        F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"),
        *[F.count(c).alias(f"with_{c}") for c in signals],
    )


def top_errors(rows: DataFrame, n: int = 5, *, order: str = "idx", errors: str = "errors", placeholder: str = "unknown") -> DataFrame:
    """A4: the ``n`` most common error kinds; an empty list counts as a placeholder, ties by first appearance."""
    kinds = rows.select(F.col(order).alias("o"), F.explode(F.when(F.size(errors) > 0, F.col(errors)).otherwise(F.array(F.lit(placeholder)))).alias("e"))
    return kinds.groupBy(error_kind(F.col("e")).alias("kind")).agg(F.count("*").alias("n"), F.min("o").alias("_o")).orderBy(F.desc("n"), "_o").limit(n).drop("_o")
