"""Constraint queries: each returns the violating rows, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.scratch import stored


def failing(df: DataFrame, rules: dict[str, Column], *columns: str) -> DataFrame:
    """The given columns and ``rule`` for every rule that a row breaks; a rule that is null is broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*columns, found.alias("_rules")).withColumn("rule", F.explode("_rules")).drop("_rules")


def unique_in(column: str) -> Column:
    return F.count("*").over(W.partitionBy(column)) == 1


def knowledge_violations(rows: DataFrame) -> DataFrame:
    """V7: id, rule: nine non-blank texts, unique ids, codes, kinds, https sources, dates, one name per city code."""
    fields = ("id", "city_code", "city_name", "kind", "name", "text", "source_title", "source_url", "verified_on")
    filled = reduce(lambda a, b: a & b, [F.coalesce(F.trim(f) != "", F.lit(False)) for f in fields])
    names = stored(rows.groupBy(F.col("city_code").alias("_code")).agg((F.count_distinct("city_name") == 1).alias("_one")), "names")
    own = {
        "fields": filled,
        "city_code": F.col("city_code").rlike(r"^\d{6}$"),
        "kind": F.col("kind").isin("food", "sight"),
        "source_url": F.col("source_url").rlike(r"^https://[^/\s?#]+"),
        "verified_on": F.col("verified_on").rlike(r"^\d{4}-\d{2}-\d{2}$"),
    }
    # what a row breaks by itself is told before any row moves: texts stay where they are, and a few codes are no key of a shuffle
    told = rows.select("id", "city_code", *[x.alias(f"_{n}") for n, x in own.items()])
    told = told.join(small(names, 24), F.col("city_code").eqNullSafe(F.col("_code")))
    rules = {"fields": F.col("_fields"), "unique_id": unique_in("id")} | {n: F.col(f"_{n}") for n in own if n != "fields"} | {"one_name": F.col("_one")}
    return failing(told, rules, "id")


def review_violations(review: DataFrame, draft: DataFrame, *, size: int = 150, accepted: str = "通过", corrected: str = "修正") -> DataFrame:
    """V6: id, rule of a review sheet against its draft; a wrong number of rows comes with a null id."""
    status, note = F.col("status"), F.coalesce(F.trim("note"), F.lit(""))
    old = draft.select("id", F.col("family").alias("_family"))
    rules = {
        "unique_id": unique_in("id"),
        "known_id": F.col("_family").isNotNull(),
        "status": status.isin(accepted, corrected),
        "note": (status != corrected) | (note != ""),
        "need_cloud": F.coalesce("need_cloud", F.lit("")).isin("", "true", "false"),
        "family": F.col("family") == F.col("_family"),
        "unique_text": unique_in("norm"),
    }
    bad = failing(review.join(old, "id", "left"), rules, "id")
    missing = old.join(review, "id", "left_anti").select("id", F.lit("missing_id").alias("rule"))
    count = review.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit(None).cast("string").alias("id"), F.lit("size").alias("rule"))
    return bad.unionAll(missing).unionAll(count)


def training_violations(rows: DataFrame) -> DataFrame:
    """V8: id, rule: ids present and unique, targets that keep the contract (``errors`` empty)."""
    return failing(rows, {"id": F.trim("id") != "", "unique_id": unique_in("id"), "target": F.size("errors") == 0}, "id")


def conversation_violations(rows: DataFrame) -> DataFrame:
    """V9: id, rule: exactly a user message and an assistant message."""
    m = F.col("messages")
    return failing(rows, {"two_messages": F.size(m) == 2, "roles": (F.get(m, F.lit(0))["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant")}, "id")


def too_long(rows: DataFrame, length: Column, most: int, *, id_col: str = "id") -> DataFrame:
    """Id, length of rows over the limit; nothing is cut."""
    return rows.select(F.col(id_col).alias("id"), length.alias("length")).where(F.col("length") > most)


def range_violations(rows: DataFrame, rules: dict[str, tuple[str, object]], *, id_col: str = "id") -> DataFrame:
    """Id, rule for lengths (``length``: lo, hi), numbers (``between``: lo, hi), patterns (``matches``) and lists (``in``)."""
    made = {}
    for column, (kind, value) in rules.items():
        c = F.col(column)
        made[column] = {"length": lambda c=c, v=value: F.char_length(c).between(*v), "between": lambda c=c, v=value: c.between(*v), "matches": lambda c=c, v=value: c.rlike(v), "in": lambda c=c, v=value: c.isin(*v)}[kind]()
    return failing(rows, made, F.col(id_col).alias("id") if id_col != "id" else "id")


def rule_audit(rows: DataFrame, rules: list[tuple[str, Column, Column, Column]], *, id_col: str = "id") -> DataFrame:
    """F16: id, rule, expected, actual: a row for each rule that a row meets; rules are (name, condition, expected, actual)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("rule"), want.alias("expected"), got.alias("actual"))) for name, when, want, got in rules]))
    return rows.select(F.col(id_col).alias("id"), F.explode(found).alias("f")).select("id", "f.*")


def target_audit(utterance: Column, scene: Column, intent: Column, need_cloud: Column) -> list[tuple[str, Column, Column, Column]]:
    """The three conflict rules of the label audit, for :func:`rule_audit`; patterns are fixed values."""
    text = lambda *parts: F.concat_ws("/", *parts)
    opening = utterance.rlike("(?:现在|此刻|目前).{0,12}(?:营业|开门|开放)")
    diet = utterance.rlike("控糖|控制血糖|减脂|控制热量")
    fresh = utterance.rlike("新鲜|变质|怎么保存|如何保存|价格") & ~utterance.rlike("怎么做|做饭|搭配|菜谱")
    return [
        ("live_opening", opening & (scene == "location") & (intent == "nearby_hint") & ~need_cloud, F.lit("need_cloud=true"), F.lit("need_cloud=false")),
        ("diet", diet & (scene == "food") & (intent != "diet_advice"), F.lit("food/diet_advice"), intent),
        ("food_quality", fresh & (scene == "food"), F.lit("none/none"), text(scene, intent)),
    ]
