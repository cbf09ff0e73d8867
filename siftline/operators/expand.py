"""Template expansion: every template with every combination of the words of its placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.operators.ranking import global_rank, interleaved
from siftline.operators.select import capped, stratified
from siftline.scratch import stored


def expand(specs: DataFrame, vocabulary: DataFrame, *, prefix: str = "scene", placeholders: int = 4) -> DataFrame:
    """Every filled template: id, seq, spec_pos, template_pos, text and the columns of ``specs`` but the templates.

    ``specs``: spec_pos, templates (array of text with ``{name}`` marks) and others; ``vocabulary``: name, pos, value.
    A template's placeholders are its known names in order of first appearance, each filled alike wherever it
    stands; unknown names stay as they are.  The combinations come from one equi-join for each placeholder, the
    first one varying slowest.  Ids number the rows in order of spec, template and combination.
    """
    words = stored(vocabulary.select("name", "pos", "value"), "words")
    known = words.select("name").distinct()
    flat = specs.select("*", F.posexplode("templates").alias("template_pos", "text")).drop("templates")
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)))
    named = flat.withColumn("_all", marks)
    per = named.select("spec_pos", "template_pos", F.posexplode("_all").alias("_i", "name")).join(small(known, 16), "name")
    ordered = per.groupBy("spec_pos", "template_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "name"))), lambda x: x["name"]).alias("_names"))
    rows = named.drop("_all").join(ordered, ["spec_pos", "template_pos"], "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    widest = rows.agg(F.max(F.size("_names"))).first()[0] or 0
    if widest > placeholders:
        raise ValueError(f"a template has {widest} placeholders; the limit is {placeholders}")
    rows = rows.withColumn("_combo", F.array().cast("array<int>"))
    for i in range(widest):
        w = words.select(F.col("name").alias("_name"), F.col("pos").cast("int").alias("_pos"), F.col("value").alias("_value"))
        name = F.get("_names", F.lit(i))
        joined = rows.join(small(w, 16), name == F.col("_name"), "left")
        text = F.when(name.isNull(), F.col("text")).otherwise(F.replace("text", F.concat(F.lit("{"), name, F.lit("}")), F.col("_value")))
        rows = joined.withColumn("text", text).withColumn("_combo", F.when(name.isNull(), F.col("_combo")).otherwise(F.concat("_combo", F.array("_pos")))).drop("_name", "_pos", "_value")
    numbered = global_rank(rows, F.col("spec_pos"), F.col("template_pos"), F.col("_combo"), name="seq")
    return numbered.drop("_names", "_combo").withColumn("id", F.format_string(f"{prefix}_%04d", "seq"))


def generate(specs: DataFrame, vocabulary: DataFrame, *, limit: int | None = None, seed: int = 20260921, group: str = "scene") -> DataFrame:
    """Expansion, caps per spec, round robin over groups and, with ``limit``, strata by group.

    ``specs`` has ``cap`` (null: none) and ``group``.  With a limit the rows come grouped, in round-robin order inside.
    """
    rows = expand(specs, vocabulary)
    cut = capped(rows, group="spec_pos", cap="cap", seed=seed, idx="seq")
    mixed = interleaved(cut.withColumnRenamed("seq", "_seq"), group, F.col("_seq")).drop("_seq")
    if limit is None:
        return mixed
    from pyspark.sql import Window as W

    from siftline.operators.select import largest_remainder

    sizes = mixed.groupBy(group).agg(F.count("*").cast("double").alias("weight"), F.min("seq").alias("_lead"))
    quota = largest_remainder(sizes, min(limit, mixed.count()), tie=[F.col("_lead")]).select(group, "quota", "_lead")
    ranked = mixed.join(small(quota, 32), group).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("seq")))
    return ranked.where("_r <= quota").orderBy("_lead", "seq").drop("_r", "quota", "_lead")


def cycled(df: DataFrame, values: list[str], *, step: int = 1, seq: str = "seq", name: str = "signals") -> DataFrame:
    """Value number ``((seq - 1) * step) mod n`` for each row."""
    table = F.array(*map(F.lit, values))
    return df.withColumn(name, F.get(table, F.pmod((F.col(seq) - 1) * step, F.lit(len(values))).cast("int")))


__all__ = ["cycled", "expand", "generate", "stratified"]
