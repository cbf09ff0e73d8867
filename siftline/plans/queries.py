"""Queries over the driver's tables, one or more for every kind of operator, with the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.functions import decisions, records, signals, text
from siftline.operators import checks, dedup, evaluate, expand, overlap, ranking, retrieval, select, traces
from siftline.session import table
from siftline.sources import files
from siftline.streaming import machines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORMAL = r"lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))"
PAIRS_SQL = f"""
norm AS (SELECT doc_id, {NORMAL} AS norm FROM documents),
texts AS (SELECT norm, min(doc_id) AS i FROM norm GROUP BY norm),
grams AS MATERIALIZED (
  SELECT i, norm, CASE WHEN length(norm) = 0 THEN []::VARCHAR[] WHEN length(norm) <= 3 THEN [norm]
    ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda k: substr(norm, CAST(k AS INTEGER), 3))) END AS g FROM texts
),
flat AS (SELECT i, len(g) AS n, unnest(g) AS gram FROM grams),
freq AS (SELECT gram, count(*) AS c FROM flat GROUP BY gram),
prefix AS (SELECT i, n, gram FROM flat JOIN freq USING (gram) QUALIFY row_number() OVER (PARTITION BY i ORDER BY c, gram) <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.i AS i, b.i AS j FROM prefix a JOIN prefix b ON a.gram = b.gram AND a.i < b.i AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
scored AS MATERIALIZED (SELECT c.i, c.j, len(a.g) AS m, len(b.g) AS n, len(list_intersect(a.g, b.g)) AS s FROM cand c JOIN grams a ON a.i = c.i JOIN grams b ON b.i = c.j),
links AS (SELECT i, j FROM scored WHERE s >= 0.8 * (m + n - s)),
both_ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach(i, r) AS (SELECT i, i FROM grams UNION SELECT b.j, reach.r FROM reach JOIN both_ways b ON reach.i = b.i),
comp AS (SELECT i, min(r) AS component FROM reach GROUP BY i),
rows_ AS (SELECT n.doc_id AS idx, t.i, c.component, CAST(coalesce(l.quality, 0) AS DOUBLE) AS p
  FROM norm n JOIN texts t USING (norm) JOIN comp c ON c.i = t.i LEFT JOIN labels l ON l.doc_id = n.doc_id),
best AS (SELECT *, first_value(idx) OVER w AS representative, first_value(i) OVER w AS ri FROM rows_ WINDOW w AS (PARTITION BY component ORDER BY p DESC, idx))
"""


def quality_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(small(labels.select("doc_id", "quality"), 24), "doc_id", "left").select(F.col("doc_id").alias("idx"), "text", F.coalesce("quality", F.lit(0)).alias("quality"))


@query(f"""
WITH RECURSIVE {PAIRS_SQL}
SELECT b.idx, b.component, b.representative, b.idx = b.representative AS kept,
  CASE WHEN b.idx <> b.representative THEN round(CASE WHEN b.i = b.ri THEN 1.0 ELSE
    CAST(len(list_intersect(x.g, y.g)) AS DOUBLE) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) END, 4) END AS jaccard
FROM best b JOIN grams x ON x.i = b.i JOIN grams y ON y.i = b.ri
""")
def dedup_documents(spark, sf_dir):
    return dedup.deduplicate(quality_of_label(spark, sf_dir), priority=F.col("quality"))


@query(f"""
WITH RECURSIVE {PAIRS_SQL}
SELECT count(*) AS total, count(*) FILTER (idx <> representative) AS removed, count(DISTINCT component) AS components FROM best
""")
def dedup_summary(spark, sf_dir):
    return dedup.removal_summary(dedup.decisions(quality_of_label(spark, sf_dir), priority=F.col("quality")))


@query(f"SELECT min(doc_id) AS first, count(*) AS size FROM documents GROUP BY {NORMAL} HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"), idx="doc_id")


OVERLAP_SQL = r"""
b AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS norm FROM benchmark),
d AS (SELECT CAST(doc_id AS VARCHAR) AS ref, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS norm FROM documents),
bg AS (SELECT id, CASE WHEN length(norm) < 3 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda k: substr(norm, CAST(k AS INTEGER), 3))) END AS g FROM b),
dg AS (SELECT ref, CASE WHEN length(norm) < 3 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda k: substr(norm, CAST(k AS INTEGER), 3))) END AS g FROM d),
shared AS (SELECT x.id, x.np, y.ref, y.nr, count(*) AS shared
  FROM (SELECT id, len(g) AS np, unnest(g) AS gram FROM bg) x JOIN (SELECT ref, len(g) AS nr, unnest(g) AS gram FROM dg) y USING (gram) GROUP BY ALL)
"""


def overlap_sides(spark, sf_dir):
    probes = overlap.normalised(table(spark, sf_dir, "benchmark"), id_col="item_id", text="text", compatibility=False)
    return probes, overlap.normalised(table(spark, sf_dir, "documents"), id_col="doc_id", text="text", compatibility=False)


@query(f"WITH {OVERLAP_SQL} SELECT b.id, d.ref FROM b JOIN d USING (norm)")
def overlap_exact(spark, sf_dir):
    return overlap.exact_matches(*overlap_sides(spark, sf_dir))


@query(f"""
WITH {OVERLAP_SQL}, capped AS (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, ref) <= 80),
scored AS (SELECT id, ref, CAST(shared AS DOUBLE) / (np + nr - shared) AS jaccard FROM capped)
SELECT id, ref, jaccard FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, ref) = 1 AND jaccard >= 0.05
""")
def overlap_near_capped(spark, sf_dir):
    return overlap.near_matches(*overlap_sides(spark, sf_dir), threshold=0.05, cap=80)


@query(f"""
WITH {OVERLAP_SQL}, scored AS (SELECT id, ref, CAST(shared AS DOUBLE) / (np + nr - shared) AS jaccard FROM shared WHERE least(np, nr) >= 0.2 * greatest(np, nr))
SELECT id, ref, jaccard FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, ref) = 1 AND jaccard >= 0.2
""")
def overlap_near_bounded(spark, sf_dir):
    return overlap.near_matches(*overlap_sides(spark, sf_dir), threshold=0.2, cap=None)


@query(f"""
WITH {OVERLAP_SQL.replace("USING (gram) GROUP", "ON x.gram = y.gram AND least(np, nr) >= 0.78 * greatest(np, nr) GROUP")}, scored AS (SELECT id, ref, CAST(shared AS DOUBLE) / (np + nr - shared) AS jaccard FROM shared)
SELECT id, ref, jaccard FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, ref) = 1 AND jaccard >= 0.78
""")
def overlap_near(spark, sf_dir):
    return overlap.near_matches(*overlap_sides(spark, sf_dir), threshold=0.78, cap=None)


def pool(spark, sf_dir):
    """Documents with a quality, a band and a cell; the band is part of the cell."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang", "source", "n_chars")
    hard = F.pmod(F.col("n_chars"), F.lit(100)) / 100.0
    rows = d.withColumn("quality", F.pmod(F.col("n_chars") * 7 + F.col("idx") % 5, F.lit(64)) / 64.0).withColumn("band", signals.band(hard))
    return rows.withColumn("cell", F.concat_ws("|", "lang", "source", "band")).select("idx", "cell", "band", "quality")


POOL_SQL = """
pool AS (SELECT idx, concat_ws('|', lang, source, band) AS cell, band, quality FROM (
  SELECT doc_id AS idx, lang, source, CAST((n_chars * 7 + doc_id % 5) % 64 AS DOUBLE) / 64.0 AS quality,
    CASE WHEN (n_chars % 100) / 100.0 < 0.34 THEN 'easy' WHEN (n_chars % 100) / 100.0 < 0.67 THEN 'medium' ELSE 'hard' END AS band FROM documents))
"""
COVER_SQL = f"""
{POOL_SQL}, gains AS (SELECT *, sqrt(sum(quality) OVER w) - sqrt(greatest(0, sum(quality) OVER w - quality)) AS gain FROM pool
  WINDOW w AS (PARTITION BY cell ORDER BY quality DESC, idx ROWS UNBOUNDED PRECEDING)),
cover AS (SELECT *, row_number() OVER (ORDER BY gain DESC, idx) AS pick FROM gains WHERE gain > 0 QUALIFY pick <= 200)
"""


@query(f"WITH {COVER_SQL} SELECT idx, cell, quality, round(gain, 9) AS gain, pick FROM cover")
def coverage_select(spark, sf_dir):
    return select.greedy_cover(pool(spark, sf_dir), 200).select("idx", "cell", "quality", F.round("gain", 9).alias("gain"), "pick")


@query(f"""
WITH {COVER_SQL}, cells AS (SELECT DISTINCT cell FROM pool), got AS (SELECT DISTINCT cell FROM cover)
SELECT count(*) AS universe, count(got.cell) AS covered, CAST(count(got.cell) AS DOUBLE) / count(*) AS ratio,
  string_agg(CASE WHEN got.cell IS NULL THEN cells.cell END, ',' ORDER BY cells.cell) AS empty FROM cells LEFT JOIN got ON cells.cell = got.cell
""")
def coverage_report(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return select.coverage_report(rows, select.greedy_cover(rows, 200)).withColumn("empty", F.nullif(F.array_join("empty", ","), F.lit("")))


@query(f"WITH {COVER_SQL}, per AS (SELECT cell, count(*) AS n, sum(quality) AS s FROM cover GROUP BY cell) SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS rows, round(sum(sqrt(s)), 6) AS objective FROM per")
def coverage_objective(spark, sf_dir):
    return select.coverage_objective(select.greedy_cover(pool(spark, sf_dir), 200)).withColumn("objective", F.round("objective", 6))


@query(f"""
WITH {POOL_SQL}, drawn AS (SELECT trial, cell, quality FROM pool, range(1, 201) t(trial)
  QUALIFY row_number() OVER (PARTITION BY trial ORDER BY md5('20260921|' || trial || '|' || idx), idx) <= 200),
per AS (SELECT trial, cell, sum(quality) AS s FROM drawn GROUP BY ALL), f AS (SELECT trial, sum(sqrt(s)) AS f FROM per GROUP BY trial)
SELECT round(avg(f), 6) AS objective FROM f
""")
def coverage_random_baseline(spark, sf_dir):
    return select.random_baseline(pool(spark, sf_dir), 200).withColumn("objective", F.round("objective", 6))


@query(f"""
WITH {POOL_SQL}, n AS (SELECT count(DISTINCT cell) AS cells FROM pool), lim AS (SELECT greatest(1, CAST(floor(200 * 0.4) AS BIGINT)) AS cap, greatest(1, CAST(floor(200 * 0.25) AS BIGINT) // cells) AS flr FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY quality DESC, idx) AS c, min(idx) OVER (PARTITION BY cell) AS lead FROM pool),
ok AS (SELECT c.* FROM c, lim WHERE c.c <= lim.cap),
one AS (SELECT ok.*, row_number() OVER (ORDER BY lead, c) AS o FROM ok, lim WHERE c <= least(lim.flr, lim.cap) QUALIFY o <= 200),
rest AS (SELECT * FROM ok WHERE idx NOT IN (SELECT idx FROM one)),
goal AS (SELECT * FROM (VALUES ('easy', 60), ('medium', 100), ('hard', 40)) g(band, target)),
have AS (SELECT band, count(*) AS have FROM one GROUP BY band),
bandlead AS (SELECT band, min(idx) AS bl FROM pool GROUP BY band),
lv AS (SELECT rest.*, g.target - coalesce(h.have, 0) - row_number() OVER (PARTITION BY rest.band ORDER BY quality DESC, idx) + 1 AS level, row_number() OVER (PARTITION BY rest.band ORDER BY quality DESC, idx) AS k, bl
  FROM rest JOIN goal g ON g.band = rest.band LEFT JOIN have h ON h.band = rest.band JOIN bandlead b ON b.band = rest.band),
two AS (SELECT *, row_number() OVER (ORDER BY level DESC, bl, k) AS o FROM lv WHERE level > 0 QUALIFY o <= 200 - (SELECT count(*) FROM one)),
three AS (SELECT *, row_number() OVER (ORDER BY quality DESC, idx) AS o FROM rest WHERE idx NOT IN (SELECT idx FROM two) QUALIFY o <= 200 - (SELECT count(*) FROM one) - (SELECT count(*) FROM two)),
picks AS (SELECT idx, 0 AS s, 'floor' AS stage, o FROM one UNION ALL SELECT idx, 1, 'mix', o FROM two UNION ALL SELECT idx, 2, 'quality', o FROM three)
SELECT idx, stage, row_number() OVER (ORDER BY s, o) AS pick FROM picks
""")
def allocate_mix(spark, sf_dir):
    return select.allocate(pool(spark, sf_dir), 200).select("idx", "stage", "pick")


@query("""
WITH w AS (SELECT o_orderpriority AS k, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY 1),
x AS (SELECT *, round(1000 * weight / sum(weight) OVER (), 9) AS x FROM w),
f AS (SELECT *, floor(x) AS f, round(sum(x) OVER ()) - sum(floor(x)) OVER () AS left_, row_number() OVER (ORDER BY x - floor(x) DESC, k) AS p FROM x)
SELECT k, CAST(f + CASE WHEN p <= left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f
""")
def quota_largest_remainder(spark, sf_dir):
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").cast("double").alias("weight"))
    return select.largest_remainder(w, 1000, tie=[F.col("k")]).select("k", "quota")


@query("""
WITH w AS (SELECT o_orderpriority AS k, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY 1),
x AS (SELECT *, round(500 * weight / sum(weight) OVER (), 9) AS x FROM w),
f AS (SELECT *, floor(x) AS f, round(sum(x) OVER ()) - sum(floor(x)) OVER () AS left_, row_number() OVER (ORDER BY x - floor(x) DESC, k) AS p FROM x),
q AS (SELECT k, CAST(f + CASE WHEN p <= left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)
SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rank FROM orders) o
JOIN q ON q.k = o.o_orderpriority WHERE rank <= quota
""")
def stratified_orders(spark, sf_dir):
    return select.stratified(table(spark, sf_dir, "orders"), 500, ["o_orderpriority"], idx="o_orderkey").select("o_orderkey", "o_orderpriority", "rank")


@query("SELECT doc_id, row_number() OVER (ORDER BY k, g, source) AS seq FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY source) AS g FROM documents)")
def round_robin_sources(spark, sf_dir):
    return ranking.interleaved(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.col("doc_id")).select("doc_id", "seq")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def global_rank_orders(spark, sf_dir):
    return ranking.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "rank")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('20260921|' || doc_id), doc_id) <= 20")
def capped_sources(spark, sf_dir):
    return select.capped(table(spark, sf_dir, "documents").withColumn("cap", F.lit(20)), group="source", cap="cap", idx="doc_id").select("doc_id", "source")


@query("SELECT doc_id, lang, round_ AS round FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1) d, range(1, 4) r(round_) ORDER BY round_, doc_id LIMIT 10")
def probe_languages(spark, sf_dir):
    return select.one_per(table(spark, sf_dir, "documents"), "lang", 10, idx="doc_id").select("doc_id", "lang", F.col("round").cast("long").alias("round"))


SIGNAL_SQL = """
sig AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 11) / 10.0 END AS consistency, CASE WHEN event_id % 4 <> 0 THEN (event_id % 21) / 20.0 END AS confidence,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 6) / 5.0 END AS agreement, event_id % 7 <> 0 AS valid FROM events)
"""


def event_signals(spark, sf_dir):
    e = F.col("event_id")
    some = lambda n, v: F.when(e % n != 0, v)
    return table(spark, sf_dir, "events").select("event_id", some(3, (e % 11) / 10.0).alias("consistency"), some(4, (e % 21) / 20.0).alias("confidence"), some(5, (e % 6) / 5.0).alias("agreement"), (e % 7 != 0).alias("valid"))


@query(f"""
WITH {SIGNAL_SQL}, w AS (SELECT *, (CASE WHEN consistency IS NULL THEN 0 ELSE 0.4 END) + (CASE WHEN confidence IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN agreement IS NULL THEN 0 ELSE 0.3 END) AS t,
  coalesce(0.4 * (1 - consistency), 0) + coalesce(0.3 * (1 - confidence), 0) + coalesce(0.3 * (1 - agreement), 0) AS m FROM sig),
d AS (SELECT *, CASE WHEN t > 0 THEN CAST(m AS DOUBLE) / CAST(t AS DOUBLE) ELSE 0.5 END AS difficulty FROM w)
SELECT event_id, round(difficulty, 6) AS difficulty,
  CASE WHEN valid THEN round(CAST(0.55 + 0.25 * coalesce(confidence, 0.5) + 0.20 * coalesce(agreement, 0.5) AS DOUBLE), 4) ELSE 0.0 END AS quality FROM d
""")
def label_signals(spark, sf_dir):
    d = signals.difficulty(F.col("consistency"), F.col("confidence"), F.col("agreement"))
    return event_signals(spark, sf_dir).select("event_id", F.round(d, 6).alias("difficulty"), signals.quality(F.col("valid"), F.col("confidence"), F.col("agreement")).alias("quality"))


@query("SELECT user_id, event_type, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def percentile_events(spark, sf_dir):
    found = ranking.group_percentiles(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 0.1)
    return found.select("user_id", "event_type", "n", F.round("at", 6).alias("p10"), F.round("mean", 6).alias("mean"))


BM25_SQL = r"""
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
asks AS (SELECT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM benchmark),
posts AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
scored AS (SELECT q.item_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score
  FROM (SELECT item_id, unnest(t) AS term FROM asks) q JOIN posts p USING (term) JOIN df USING (term), st GROUP BY ALL)
"""


@query(f"WITH {BM25_SQL}, r AS (SELECT item_id, doc_id, round(score, 4) AS score FROM scored) SELECT item_id, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 4")
def bm25_top(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("all", F.lit("all"))
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.lit("all").alias("grp"), text.retrieval_tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    found = retrieval.scores(docs, asks, group="all", doc="doc_id", text=F.col("text")).withColumn("score", F.round("score", 4))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc"))).where("r <= 4")
    return ranked.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "score")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, NOT regexp_matches(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '404|not found') AS alive FROM pages")
def page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", records.page_title(F.col("html")).alias("title"))
    return p.withColumn("alive", records.page_alive(F.lit(200), F.col("title")))


@query("SELECT page_id, rule FROM (SELECT page_id, unnest(list_filter([CASE WHEN NOT regexp_matches(url, '^https://[^/\\s?#]+') THEN 'https' END, CASE WHEN NOT length(url) BETWEEN 1 AND 40 THEN 'length' END], lambda x: x IS NOT NULL)) AS rule FROM pages)")
def page_rules(spark, sf_dir):
    rules = {"https": F.col("url").rlike(r"^https://[^/\s?#]+"), "length": F.char_length("url").between(1, 40)}
    return checks.failing(table(spark, sf_dir, "pages"), rules, "page_id")


@query(r"""
SELECT doc_id AS id, rule, expected, actual FROM (
  SELECT doc_id, 'license' AS rule, 'permissive' AS expected, source AS actual FROM documents WHERE regexp_matches(text, 'GNU|CC BY-NC')
  UNION ALL SELECT doc_id, 'shout', 'mixed case', lang FROM documents WHERE regexp_matches(text, '(?:[A-Z]{4,}!! ){3}'))
""")
def rule_audit(spark, sf_dir):
    t = F.col("text")
    rules = [("license", t.rlike("GNU|CC BY-NC"), F.lit("permissive"), F.col("source")), ("shout", t.rlike("(?:[A-Z]{4,}!! ){3}"), F.lit("mixed case"), F.col("lang"))]
    return checks.rule_audit(table(spark, sf_dir, "documents"), rules, id_col="doc_id")


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, string_agg(role || '：' || text, chr(10) ORDER BY turn, role || '：' || text) AS dialogue FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id")
def dialogue_flatten(spark, sf_dir):
    return traces.flattened(table(spark, sf_dir, "conversations"))


@query("""
SELECT conv_id || '-' || turn AS id, text AS asked, next_text AS answered FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'
""")
def sft_messages(spark, sf_dir):
    rows = traces.message_pairs(table(spark, sf_dir, "conversations"))
    return rows.select("id", F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("answered"))


@query("""
WITH m AS (SELECT conv_id AS id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT id, 'two_messages' AS rule FROM m WHERE len(r) <> 2 UNION ALL SELECT id, 'roles' FROM m WHERE NOT coalesce(r[1] = 'user' AND r[2] = 'assistant', false)
""")
def sft_shape_violations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    return checks.conversation_violations(turns)


@query("SELECT min(length(text)) AS least, avg(length(text)) AS mean, max(length(text)) AS most FROM conversations")
def message_lengths(spark, sf_dir):
    return traces.lengths(table(spark, sf_dir, "conversations"), F.char_length("text").cast("long"))


@query("SELECT conv_id AS id, length(text) AS length FROM conversations WHERE length(text) > 900")
def too_long_messages(spark, sf_dir):
    return checks.too_long(table(spark, sf_dir, "conversations"), F.char_length("text").cast("long"), 900, id_col="conv_id")


TRACE_SQL = "tr AS (SELECT event_id AS id, ts, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'edge' ELSE 'cloud' END AS executor, event_id % 10 <> 0 AS success, CAST(event_id % 4000 AS BIGINT) AS total_ms FROM events)"


def event_traces(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(e % 3 == 0, "edge").otherwise("cloud").alias("executor"), (e % 10 != 0).alias("success"), (e % 4000).alias("total_ms"))


STATS = "count(*) AS total, count(*) FILTER (executor = 'edge') AS edge, count(*) FILTER (executor <> 'edge') AS cloud, count(*) FILTER (NOT success) AS failed, avg(CASE WHEN success THEN total_ms END) AS mean_ms, CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (executor <> 'edge') AS DOUBLE) / count(*) ELSE 0 END AS cloud_share"


@query(f"WITH {TRACE_SQL} SELECT user_id, {STATS} FROM tr GROUP BY user_id")
def trace_stats_by_user(spark, sf_dir):
    return traces.trace_stats(event_traces(spark, sf_dir), "user_id")


@query(f"WITH {TRACE_SQL} SELECT {STATS} FROM tr WHERE CAST(ts + INTERVAL 8 HOURS AS DATE) = DATE '2024-01-10'")
def today_stats(spark, sf_dir):
    ms = F.unix_millis("ts")
    return traces.trace_stats(event_traces(spark, sf_dir).where(records.on_day(ms, F.lit("2024-01-10").cast("date"), "Asia/Shanghai")))


@query(f"WITH {TRACE_SQL} SELECT id, epoch_us(ts) AS at FROM tr ORDER BY ts DESC, id DESC LIMIT 30")
def recent_traces(spark, sf_dir):
    return ranking.newest(event_traces(spark, sf_dir), 30, "ts", "id").select("id", F.unix_micros("ts").alias("at"))


@query("""
WITH s AS (SELECT event_id AS id, unnest(['net', 'model', 'edge_decision']) AS stage, unnest([event_id % 50, event_id % 7, event_id % 3]) AS ms FROM events)
SELECT id, stage, ms, CAST(ms AS DOUBLE) / greatest(1, sum(ms) OVER (PARTITION BY id)) AS share FROM s
""")
def latency_shares(spark, sf_dir):
    e = F.col("event_id")
    own = F.create_map(F.lit("net"), e % 50, F.lit("model"), e % 7, F.lit("edge_decision"), F.lit(99).cast("long"))
    rows = table(spark, sf_dir, "events").select(e.alias("id"), traces.merged_stages(own, F.create_map(F.lit("edge_decision"), e % 3)).alias("stages"))
    return traces.stage_shares(rows)


@query("SELECT event_type, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 4) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def event_histogram(spark, sf_dir):
    return traces.histogram(table(spark, sf_dir, "events"), "event_type")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS pairs, (SELECT count(DISTINCT n_chars) FROM documents) AS values")
def distinct_counts(spark, sf_dir):
    return traces.pair_counts(table(spark, sf_dir, "documents"), "lang", "source", "n_chars")


@query("SELECT source AS key, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def ids_by_source(spark, sf_dir):
    return traces.grouped_ids(table(spark, sf_dir, "documents"), "source", "doc_id").select(F.col("source").alias("key"), F.array_join("ids", ",").alias("ids"))


ROUTE_SQL = """
r AS (SELECT event_id, event_id % 2 = 0 AS ready, event_id % 3 <> 0 AS preferred, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 <> 0 END AS valid,
  CASE WHEN event_id % 11 <> 0 THEN (event_id % 100) / 100.0 END AS complexity, CASE WHEN event_id % 13 <> 0 THEN (event_id % 97) / 97.0 END AS confidence, 100 + event_id % 2000 AS edge_ms FROM events)
"""


@query(f"""
WITH {ROUTE_SQL} SELECT event_id, CASE WHEN NOT ready OR NOT preferred OR valid = false OR complexity > 0.85 OR confidence IS NULL THEN 'cloud' WHEN CAST(confidence AS DOUBLE) >= 0.85 - CAST(0.00025 AS DOUBLE) * greatest(0, 1200 - edge_ms) THEN 'edge' ELSE 'cloud' END AS kind,
  CASE WHEN NOT ready THEN 'not_ready' WHEN NOT preferred THEN 'not_preferred' WHEN valid = false THEN 'invalid' WHEN complexity > 0.85 THEN 'too_complex' WHEN confidence IS NULL THEN 'no_confidence'
  WHEN CAST(confidence AS DOUBLE) >= 0.85 - CAST(0.00025 AS DOUBLE) * greatest(0, 1200 - edge_ms) THEN 'confident' ELSE 'unsure' END AS reason FROM r
""")
def routing(spark, sf_dir):
    e = F.col("event_id")
    valid = F.when(e % 5 == 0, F.lit(None)).otherwise(e % 7 != 0)
    complexity, confidence = F.when(e % 11 != 0, (e % 100) / 100.0), F.when(e % 13 != 0, (e % 97) / 97.0)
    r = records.route(e % 2 == 0, e % 3 != 0, valid, complexity, confidence, 100 + e % 2000)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.kind", "r.reason")


@query("""
SELECT event_id, CASE WHEN m < 1000 THEN CAST(m AS VARCHAR) || ' ms' ELSE printf('%.1f s', floor(m / 100.0 + 0.5) / 10) END AS took,
  CASE WHEN a = b THEN true WHEN a < b THEN mi >= a AND mi < b ELSE mi >= a OR mi < b END AS quiet, CASE WHEN event_id % 4 = 0 THEN 'x' || event_id ELSE '…' END AS title
FROM (SELECT event_id, event_id % 5000 AS m, event_id % 1440 AS mi, event_id % 24 * 60 AS a, event_id % 7 * 200 AS b FROM events)
""")
def row_formats(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 4 == 0, F.concat(F.lit("x"), e.cast("string"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", records.duration(e % 5000).alias("took"), records.in_window(e % 1440, e % 24 * 60, e % 7 * 200).alias("quiet"), records.title_of(name, "…").alias("title"))


@query("SELECT doc_id, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS hash, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256, substr(text, 1, 200) AS head FROM documents")
def text_digests(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.text_hash(t).alias("hash"), F.md5(t.cast("binary")).alias("md5"), F.sha2(t.cast("binary"), 256).alias("sha256"), text.clip(F.col("text"), 200).alias("head"))


@query(f"SELECT item_id, length(norm) AS n, CASE WHEN length(norm) = 0 THEN 0 WHEN length(norm) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(norm) - 1), lambda k: substr(norm, CAST(k AS INTEGER), 3)))) END AS grams FROM (SELECT item_id, {NORMAL} AS norm FROM benchmark)")
def shingle_counts(spark, sf_dir):
    norm = text.dedup_normal(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", norm.alias("norm")).select("item_id", F.char_length("norm").cast("long").alias("n"), F.size(text.shingles(F.col("norm"))).cast("long").alias("grams"))


def event_keys(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(t) / 1e6).alias("ts_seconds"), F.unix_millis(t).alias("ts_ms"))


@query()
def rate_limit_replay(spark, sf_dir):
    rows = event_keys(spark, sf_dir).select("event_id", F.pmod("user_id", F.lit(20)).alias("key"), "ts_seconds")
    return machines.rate_limited(rows, seq="event_id", per_minute=1, per_day=12)


@query()
def place_change_replay(spark, sf_dir):
    rows = event_keys(spark, sf_dir).select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("city_code"), "ts_ms")
    return machines.place_changes(rows, order=["ts_ms", "event_id"])


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id % 20 AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
passed AS (
  SELECT k, n, t FROM e WHERE n = 1
  UNION ALL
  SELECT p.k, x.n, x.t FROM passed p, LATERAL (SELECT n, t FROM e WHERE e.k = p.k AND e.t >= p.t + 7200000000 ORDER BY e.n LIMIT 1) x
)
SELECT e.event_id, e.k AS key, p.n IS NOT NULL AS passed FROM e LEFT JOIN passed p ON p.k = e.k AND p.n = e.n
""")
def throttle_replay(spark, sf_dir):
    """ST3: twenty keys, so that each has many events."""
    rows = event_keys(spark, sf_dir).select("event_id", F.pmod("user_id", F.lit(20)).alias("key"), "ts_seconds")
    return machines.throttled(rows, seq="event_id", gap=7200).select("event_id", "key", "passed")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled(spark, sf_dir):
    return files.todo(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def replaced_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return traces.replaced(docs, table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, round(CAST(count(*) FILTER (valid) AS DOUBLE) / count(*), 4) AS valid_rate, round(avg(event_id % 3000), 1) AS mean_latency_ms, count(consistency) AS with_consistency, count(confidence) AS with_confidence, count(agreement) AS with_agreement FROM (WITH " + SIGNAL_SQL + " SELECT * FROM sig)")
def label_summary(spark, sf_dir):
    return evaluate.label_summary(event_signals(spark, sf_dir).withColumn("latency_ms", F.col("event_id") % 3000))


@query("SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id) m ON e.user_id = m.user_id AND CAST(e.ts AS DATE) = m.d")
def latest_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("session_id", F.to_date("ts"))
    return traces.current_sessions(rows).select("user_id", "event_id")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def first_orders(spark, sf_dir):
    return ranking.first_per(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey")


@query("SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS ids FROM (SELECT doc_id, 'documents' AS source FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels) GROUP BY source")
def tagged_union(spark, sf_dir):
    both = overlap.tagged_union(documents=table(spark, sf_dir, "documents").select("doc_id"), labels=table(spark, sf_dir, "labels").select("doc_id"))
    return both.groupBy(F.col("origin").alias("source")).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))


@query("SELECT event_id, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS k FROM events WHERE props LIKE '{\"k\": %}'")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE value < 10 GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def top_error_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value < 10").select(F.col("event_id").alias("idx"), F.array(F.concat("event_type", F.lit(":x"))).alias("errors"))
    return evaluate.top_errors(rows, 3)
