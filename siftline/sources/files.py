"""File sources and sinks: JSON lines, TSV, knowledge bases, digests, manifests, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What may stand round an object on its line.
BLANKS = " \t\n\r\x0b\x0c"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, *, allow_empty: bool = True) -> DataFrame:
    """One object per line; blank lines are skipped, anything else that is no object fails the query.

    Adds ``line_no``, the order of lines, unique and rising within and over files.  With ``allow_empty=False`` a
    file without rows is an error.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.btrim("value", F.lit(BLANKS)).alias("value")).where("value != ''")
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80))))
    checked = lines.withColumn("value", F.when(F.col("value").rlike(r"(?s)^\{.*\}$"), F.col("value")).otherwise(bad))
    kind = schema.simpleString() if isinstance(schema, T.StructType) else schema
    rows = checked.select("line_no", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("line_no", "r.*")
    if not allow_empty and lines.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file that is one object."""
    text = spark.read.text(path, wholetext=True)
    top = F.when(F.btrim("value", F.lit(BLANKS)).startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("the top level is no object")))
    return text.select(F.from_json(top, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def last_predictions(rows: DataFrame) -> DataFrame:
    """Id, text: of equal ids the last line; text, else output, else empty; lines without id share null."""
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("output"), F.lit(""))
    return rows.groupBy("id").agg(F.max_by(text, "line_no").alias("text"))


def id_differences(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: ids of ``rows`` that are repeated, ids of ``ids`` that are missing there, ids that nobody asked for."""
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    both = counts.withColumn("here", F.lit(1)).join(ids.select("id").distinct().withColumn("asked", F.lit(1)), "id", "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("here").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("extra"))


def strict_predictions(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The predictions, if their ids are exactly ``ids``, once each; else an error that counts the cases."""
    bad = id_differences(rows, ids).first()
    if any(bad):
        raise ValueError(f"predictions: {bad[0]} ids repeated, {bad[1]} missing, {bad[2]} extra")
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text"))


def read_tsv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A TSV whose header is exactly ``header``, a byte-order mark aside; all columns are strings."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", encoding="UTF-8")
    names = [c.lstrip("﻿") for c in df.columns]
    if names != header:
        raise ValueError(f"header {names} is not {header}")
    return df.toDF(*names)


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """The items of a knowledge base with their file position, if none breaks a rule (V7)."""
    from siftline.operators.checks import knowledge_violations

    fields = "id, city_code, city_name, kind, name, text, source_title, source_url, verified_on".split(", ")
    rows = read_jsonl(spark, path, ", ".join(f"{f} string" for f in fields)).withColumnRenamed("line_no", "pos")
    if bad := knowledge_violations(rows).limit(5).collect():
        raise ValueError(f"knowledge base: {[tuple(r) for r in bad]}")
    return rows


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, md5, sha256 of whole files, byte for byte."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def require_digest(spark: SparkSession, path: str, expected: str, kind: str = "sha256") -> None:
    """An error unless the one file has this digest."""
    found = [r[kind] for r in digests(spark, path).select(kind).limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"{path}: digest {found} is not {expected}")


def uploads(spark: SparkSession, path: str, kinds: tuple[str, ...], most_bytes: int) -> DataFrame:
    """Files of the allowed kinds (by their first bytes) and size, with kind and content."""
    from siftline.functions.records import sniff

    files = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, most_bytes))
    return files.withColumn("kind", sniff(F.col("content"))).where(F.col("kind").isin(*kinds))


def todo(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Rows that the cache does not have."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON lines; an existing target is an error unless it is to be replaced."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A TSV with clean cells; an existing target is an error."""
    from siftline.functions.text import clean_cell

    cells = [clean_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("errorifexists").csv(path, sep="\t", header=True, quote="", emptyValue="")


def row_digest(df: DataFrame) -> list[Column]:
    """Two 60-bit numbers of each row: halves of the MD5 of its fields, each with its length in front, null as ``-``."""
    fields = [F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    whole = F.md5(F.concat(*fields).cast("binary"))
    return [F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def manifest(df: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """One row: rows, distinct ids, histogram of a column, and a digest that no order of rows changes.

    The digest is the sums of two numbers of every row, so parts of a table can be digested apart and added, and a repeated
    row counts twice.
    """
    counts = df.groupBy(group).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(group).cast("string"), F.lit("")), "count")))).alias("histogram"))
    halves = [F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in row_digest(df)]
    whole = df.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids"), F.concat_ws(":", *halves).alias("digest"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  both sides are a single row
    return one(whole).join(one(counts), "_one").drop("_one")


def public_fields(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Only the allowed fields of the allowed structs, in order of name."""
    return df.select(*[F.struct(*[F.col(f"{s}.{f}").alias(f) for f in sorted(fields)]).alias(s) for s, fields in sorted(allowed.items())])


def numbered(df: DataFrame, prefix: str, *order: Column | str, width: int = 4) -> DataFrame:
    """Ids ``prefix_0001`` and on in the given order; ranks come from sorted range partitions, not from one task."""
    from siftline.operators.ranking import global_rank  # stands on this module

    ranked = global_rank(df, *(F.col(x) if isinstance(x, str) else x for x in order), name="_number")
    return ranked.withColumn("id", F.format_string(f"{prefix}_%0{width}d", F.col("_number"))).drop("_number")
