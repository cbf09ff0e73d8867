"""More queries over the driver's tables: column functions, sources and sinks, contracts and sets, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import decisions, records, signals, text
from siftline.operators import checks, contract, evaluate, expand, ranking, retrieval, select, traces
from siftline.plans.queries import COVER_SQL, pool, query
from siftline.scratch import new_path
from siftline.session import table
from siftline.sources import files


def picked(values: tuple, index):
    """The value at ``index`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_picked(values: tuple, index: str) -> str:
    named = ", ".join("NULL" if v is None else repr(v) for v in values)
    return f"([{named}])[1 + (({index}) % {len(values)})]"


PROBS_SQL = "probs AS (SELECT user_id, -abs(value) / 1000.0 AS x FROM events WHERE value IS NOT NULL)"


@query(f"""
WITH {PROBS_SQL}, per AS (SELECT user_id, quantile_cont(x, 0.1) AS p, avg(x) AS m, count(*) AS n FROM probs GROUP BY user_id)
SELECT user_id, round(p, 6) AS p10, round(m, 6) AS mean, round(exp(p), 4) AS confidence,
  round(pow(exp(m), 1 / greatest(1.0, log10(n + 10))), 6) AS adjusted FROM per
""")
def logprob_signals(spark, sf_dir):
    """A10, A11, X17."""
    probs = table(spark, sf_dir, "events").select("user_id", (-F.abs("value") / 1000.0).alias("x"))
    rows = ranking.group_percentiles(probs, ["user_id"], "x", 0.1)
    adjusted = signals.length_adjusted_confidence(F.col("mean"), F.col("n"))
    return rows.select("user_id", F.round("at", 6).alias("p10"), F.round("mean", 6).alias("mean"), F.round(F.exp("at"), 4).alias("confidence"), F.round(adjusted, 6).alias("adjusted"))


STATUSES = (None, 200, 204, 299, 400, 401, 403, 404, 413, 418, 422, 429, 500, 501, 502, 503, 504, 599)


@query(f"""
WITH s AS (SELECT event_id, {sql_picked(STATUSES, 'event_id')} AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN 'network' WHEN s // 100 = 2 THEN 'ok' WHEN s IN (401, 403) THEN 'auth' WHEN s = 404 THEN 'missing' WHEN s = 413 THEN 'too_large'
  WHEN s = 422 THEN 'invalid' WHEN s = 429 THEN 'limited' WHEN s IN (502, 503, 504) THEN 'upstream' WHEN s >= 500 THEN 'server' ELSE 'client' END AS class FROM s
""")
def error_classes(spark, sf_dir):
    """X32."""
    return table(spark, sf_dir, "events").select("event_id", records.error_class(picked(STATUSES, F.col("event_id"))).alias("class"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'edge' ELSE 'cloud' END AS executor, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE 'other' END AS verb FROM events
""")
def executors(spark, sf_dir):
    """X28, X33."""
    kind = picked(("edge", "cloud", None), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", records.executor(kind).alias("executor"), records.lookup(F.col("event_type"), {"click": "tap", "view": "look"}, "other").alias("verb"))


GOALS, INTENTS, EDGE = ("", None, "拒绝", "推迟"), ("reply_suggest", "rewrite", "tone_adjust"), ("不指定", "接受", None, "降低冲突", "转移话题")


@query(f"""
WITH g AS (SELECT event_id, {sql_picked(GOALS, 'event_id')} AS e, {sql_picked(INTENTS, 'event_id // 4')} AS i, {sql_picked(EDGE, 'event_id // 12')} AS d FROM events)
SELECT event_id, CASE WHEN e <> '' THEN e WHEN i = 'reply_suggest' AND d <> '不指定' THEN d ELSE '' END AS goal FROM g
""")
def chosen_goals(spark, sf_dir):
    """X30."""
    e = F.col("event_id")
    goal = records.chosen_goal(picked(GOALS, e), picked(INTENTS, F.floor(e / 4)), picked(EDGE, F.floor(e / 12)))
    return table(spark, sf_dir, "events").select("event_id", goal.alias("goal"))


@query("SELECT event_id, event_id % 200 - 20 BETWEEN 0 AND 120 AND (event_id * 37) % 5000 <= 3000 AS good FROM events")
def location_fixes(spark, sf_dir):
    """F13."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", records.good_fix(e % 200 - 20, (e * 37) % 5000).alias("good"))


HEADS = (10, 11, 127, 172, 192, 169, 8, 100)


@query(f"""
WITH a AS (SELECT event_id, {sql_picked(HEADS, 'event_id')} AS a, {sql_picked((168, 16, 31, 32, 254, 15, 1), 'event_id // 8')} AS b FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN true WHEN event_id % 11 = 1 THEN true WHEN event_id % 11 = 2 THEN false
  ELSE a IN (10, 127) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) END AS private FROM a
""")
def private_hosts(spark, sf_dir):
    """addresses, local names and public names."""
    e = F.col("event_id")
    address = F.concat_ws(".", picked(HEADS, e), picked((168, 16, 31, 32, 254, 15, 1), F.floor(e / 8)), e % 256, F.lit(7))
    host = F.when(e % 11 == 0, "localhost").when(e % 11 == 1, F.concat(F.lit("box"), e, F.lit(".local"))).when(e % 11 == 2, "10.example.org").otherwise(address)
    return table(spark, sf_dir, "events").select("event_id", records.private_host(host).alias("private"))


CODES, ADCODES = ("110000", "310000", "440300", "429004", "330100"), ("110105", "310101", "440305", "429004", "429005", "330106", "500101")


@query(f"""
WITH c AS (SELECT event_id, {sql_picked(CODES, 'event_id')} AS c, {sql_picked(ADCODES, 'event_id // 5')} AS a FROM events)
SELECT event_id, CASE WHEN c[1:2] IN ('11', '12', '31', '50') THEN c[1:2] = a[1:2] WHEN c[3:4] = '90' THEN c = a ELSE c[1:4] = a[1:4] END AS same FROM c
""")
def same_places(spark, sf_dir):
    """F9."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", records.same_place(picked(CODES, e), picked(ADCODES, F.floor(e / 5))).alias("same"))


@query(f"SELECT event_id, 'https://map.example/s?query=' || url_encode('北京' || event_type) || '&city=' || {sql_picked(CODES, 'event_id')} AS url FROM events")
def map_urls(spark, sf_dir):
    """X34."""
    url = records.map_search_url("https://map.example/s", picked(CODES, F.col("event_id")), F.concat(F.lit("北京"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", url.alias("url"))


SPACES = r"regexp_replace({}, '\s+', '', 'g')"


@query(f"""
WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 40) || '~' WHEN doc_id % 7 = 0 THEN '  ' ELSE replace(substr(text, 5, 40), ' ', '   ') END AS e FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(e) <> '' AND contains({SPACES.format('text')}, {SPACES.format('e')}) AS supported FROM e
""")
def evidence(spark, sf_dir):
    """F8: whether evidence, white space aside, is part of its source."""
    part = F.substring("text", 5, 40)
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(part, F.lit("~"))).when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.replace(part, F.lit(" "), F.lit("   ")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", records.evidence_supported(quote, F.col("text")).alias("supported"))


@query("""
WITH d AS (SELECT event_id, 1 + event_id % 28 AS d, event_id % 24 AS h, event_id % 60 AS m, event_id % 5 AS off FROM events),
t AS (SELECT *, printf('2026-03-%02d', d) AS day, printf('%02d:%02d', h, m) AS clock FROM d)
SELECT event_id, CASE WHEN off = 0 OR off = 3 THEN day || 'T' || clock || ':00+08:00' END AS due_at FROM t
""")
def due_times(spark, sf_dir):
    """A due time stands only if its evidence states the very day and time."""
    e = F.col("event_id")
    d, h, m = 1 + e % 28, e % 24, e % 60
    stamp = F.format_string("2026-03-%02dT%02d:%02d:00", d, h, m)
    due = F.concat(stamp, F.when(e % 5 == 2, "+09:00").otherwise("+08:00"))
    said = F.when(e % 5 == 1, F.format_string("2026年3月%d日 %d:%02d", d + 1, h, m)).when(e % 5 == 4, F.lit("下周一")).when(e % 5 == 3, F.format_string("2026/3/%d %d:%02d", d, h, m)).otherwise(F.format_string("交于2026年3月%d日%d:%02d前", d, h, m))
    return table(spark, sf_dir, "events").select("event_id", records.supported_due(due, said).alias("due_at"))


@query("""
WITH n AS (SELECT doc_id, doc_id % 9 AS n, doc_id % 7 AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i > p AND i <= n THEN i ELSE -100 END), ' ') AS labels FROM n
""")
def supervision_masks(spark, sf_dir):
    """X36; a prompt of more ids than the row has hides them all."""
    n = (F.col("doc_id") % 9).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    mask = F.transform(records.supervision_mask((F.col("doc_id") % 7).cast("int"), ids, F.lit(12)), lambda x: x.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(mask, " ").alias("labels"))


SETS_SQL = "sets AS (SELECT o_orderkey AS k, o_custkey AS c, list_distinct(['s=' || o_orderstatus, 'p=' || o_orderpriority, 'y=' || year(o_orderdate)]) AS s FROM orders)"
JACCARD_SQL = "CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s)))"


def order_sets(spark, sf_dir):
    fields = {"s": F.col("o_orderstatus"), "p": F.col("o_orderpriority"), "y": F.year("o_orderdate")}
    none = F.lit(None).cast("map<string,string>")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), signals.pairs_of(fields, none).alias("s"))


@query(f"WITH {SETS_SQL} SELECT a.c, round(avg({JACCARD_SQL}), 6) AS consistency FROM sets a JOIN sets b ON a.c = b.c AND a.k < b.k GROUP BY a.c")
def pairwise_consistencies(spark, sf_dir):
    """Over all pairs of a customer's orders."""
    per = order_sets(spark, sf_dir).groupBy("c").agg(F.collect_list("s").alias("s"))
    return per.select("c", F.round(signals.pairwise_consistency(F.col("s")), 6).alias("consistency")).where("consistency is not null")


@query(f"WITH {SETS_SQL} SELECT a.k, round({JACCARD_SQL}, 6) AS agreement FROM sets a JOIN sets b ON b.k = (SELECT min(k) FROM sets)")
def field_agreements(spark, sf_dir):
    """Each order with the first one."""
    rows = order_sets(spark, sf_dir)
    first = rows.orderBy("k").limit(1).select(F.col("s").alias("t"), F.lit(1).alias("one"))
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(first), "one")  # one row
    return both.select("k", F.round(signals.field_agreement(F.col("s"), F.col("t")), 6).alias("agreement"))


@query("""
SELECT c_custkey, octet_length(encode('{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "c_mktsegment": "' || c_mktsegment || '"}')) AS bytes FROM customer
""")
def json_sizes(spark, sf_dir):
    """A5: bytes of a row as spaced JSON."""
    return table(spark, sf_dir, "customer").select("c_custkey", signals.json_bytes(F.struct("c_custkey", "c_name", "c_mktsegment")).cast("long").alias("bytes"))


@query("SELECT doc_id, (['dark', 'quiet', 'moving', 'late', 'crowd'])[1 + (doc_id * 3) % 5] AS signals FROM documents")
def cycled_signals(spark, sf_dir):
    """S10, S11."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("seq"))
    return expand.cycled(rows, ["dark", "quiet", "moving", "late", "crowd"], step=3).select("doc_id", "signals")


@query("""
WITH a AS (SELECT doc_id AS idx FROM documents WHERE doc_id % 10 = 0), b AS (SELECT doc_id AS idx FROM documents WHERE doc_id % 10 <> 0)
SELECT idx FROM a UNION ALL (SELECT idx FROM b ORDER BY idx LIMIT 17 + (SELECT count(*) FROM a) - (SELECT count(*) FROM a))
""")
def topped_up(spark, sf_dir):
    """T5: a pick that lacks 17 rows."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    own = rows.where("idx % 10 = 0")
    return select.top_up(own, rows.where("idx % 10 != 0"), own.count() + 17)


@query("SELECT doc_id, coalesce(text, '') AS text, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Written as JSON lines and read again."""
    path = new_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string").drop("line_no")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_clerk FROM (SELECT o_orderkey, o_orderpriority, 'clerk ' || o_custkey AS o_clerk FROM orders)")
def tsv_round_trip(spark, sf_dir):
    """Written as TSV with tabs and line breaks cleaned, and read again."""
    path = new_path(spark, "tsv")
    clerk = F.concat(F.lit("clerk\t"), F.col("o_custkey").cast("string"))
    files.write_tsv(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority", clerk.alias("o_clerk")), path)
    return files.read_tsv(spark, path, ["o_orderkey", "o_orderpriority", "o_clerk"])


@query("SELECT event_type, user_id % 50 AS id, max_by(coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE props END, ''), 'out' || event_id, ''), event_id) AS text FROM events GROUP BY ALL")
def last_predictions(spark, sf_dir):
    """Of repeated ids the last line counts; an empty text falls back to the output."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", F.col("user_id") % 50).alias("id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("text"), F.concat(F.lit("out"), "event_id").alias("output"))
    parts = F.split("id", r"\|")
    return files.last_predictions(rows).select(parts[0].alias("event_type"), parts[1].cast("long").alias("id"), "text")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def still_to_label(spark, sf_dir):
    """S13, J3."""
    return files.todo(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("SELECT doc_id, printf('doc_%05d', row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS id FROM documents")
def numbered_documents(spark, sf_dir):
    """W6."""
    return files.numbered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc", F.desc("n_chars"), F.col("doc_id"), width=5).select("doc_id", "id")


@query("""
WITH f AS (SELECT md5(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(text) || ':' || text, '-')) AS m FROM documents)
SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT lang AS l, count(*) AS n FROM documents GROUP BY lang)) AS langs,
  (SELECT CAST(sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT)) AS VARCHAR) FROM f) AS digest FROM documents
""")
def document_manifest(spark, sf_dir):
    """K10."""
    made = files.manifest(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang", "doc_id")
    return made.select("rows", "ids", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("langs"), "digest")


@query("SELECT e.event_id FROM events e WHERE event_type IN (SELECT event_type FROM events GROUP BY event_type HAVING event_type < 'm')")
def rows_of_group(spark, sf_dir):
    """F11."""
    rows = table(spark, sf_dir, "events").withColumn("scene", F.col("event_type"))
    groups = rows.select("scene").distinct().withColumn("scene_group", F.when(F.col("scene") < "m", "early").otherwise("late"))
    return traces.of_group(rows, groups, "early").select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 5 = 4 AND event_id % 3 <> 0 AND (SELECT max(ts) FROM events) - ts < INTERVAL 24 HOURS")
def fresh_rows(spark, sf_dir):
    """ST8."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("version"), (F.col("event_id") % 3 != 0).alias("complete"), F.col("ts").alias("cached_at"))
    now = rows.agg(F.max("cached_at")).first()[0]
    return traces.fresh_cache(rows, F.lit(now)).select("event_id")


@query(f"WITH {COVER_SQL} SELECT round(max(gain) FILTER (pick = 1), 9) AS first, round(max(gain) FILTER (pick = 200), 9) AS last FROM cover")
def coverage_gain_range(spark, sf_dir):
    """W5."""
    found = select.gain_range(select.greedy_cover(pool(spark, sf_dir), 200))
    return found.select(F.round("first", 9).alias("first"), F.round("last", 9).alias("last"))


@query("SELECT 'known' AS asked, o_orderkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'unknown', min(o_orderkey) FROM orders")
def one_row_by_id(spark, sf_dir):
    """The asked row, or the first one."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    known, unknown = (select.by_id_or_first(orders, "o_orderkey", x, F.col("o_orderkey")) for x in (last, -1))
    return known.select(F.lit("known").alias("asked"), "o_orderkey").unionAll(unknown.select(F.lit("unknown"), "o_orderkey"))


@query("SELECT n_nationkey AS code, CASE WHEN o % 2 = 0 THEN 'food' ELSE 'sight' END AS kind, count(*) AS n FROM (SELECT c_nationkey AS n_nationkey, c_custkey AS o FROM customer) GROUP BY ALL")
def kb_inventory(spark, sf_dir):
    """A22."""
    kb = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city_code"), F.when(F.col("c_custkey") % 2 == 0, "food").otherwise("sight").alias("kind"), F.col("c_custkey").alias("id"))
    return retrieval.inventory(kb).select(F.col("city_code").alias("code"), "kind", "n")


#: Parts of decisions, taken by the event's id; some break the contract.
SCENES, ASKED, COMPLEX, NEED, LENGTHS, SOURCES = ("reading", "none", "cooking"), ("summarize", "none", "key_points"), ("0.25", "1", "1.5", "true", "0.75"), ("true", "false", '"no"', "false"), ("120", "-3", "4.5", '"9"'), ('"text"', '"pdf"', '"web"')


def decision_texts(spark, sf_dir):
    e = F.col("event_id")
    at = lambda values, by: picked(values, F.floor(e / by))
    slots = F.when(at(SCENES, 1) == "reading", F.concat(F.lit('{"text_length": '), at(LENGTHS, 3), F.when(e % 7 != 0, F.concat(F.lit(', "source": '), at(SOURCES, 5))).otherwise(""), F.lit("}"))).otherwise(F.when(e % 13 == 0, '{"x": 1}').otherwise("{}"))
    body = F.concat(F.lit('{"scene": "'), at(SCENES, 1), F.lit('", "intent": "'), at(ASKED, 2), F.lit('", "complexity": '), at(COMPLEX, 4), F.lit(', "confidence": 0.5, "need_cloud": '), at(NEED, 6), F.lit(', "slots": '), slots, F.when(e % 17 == 0, ', "note": 1}').otherwise("}"))
    wrapped = F.when(e % 19 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(e % 19 == 1, F.concat(F.lit("so "), body, F.lit(" ok"))).when(e % 19 == 2, F.lit("no answer")).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", wrapped.alias("text"))


DECISION_SQL = f"""
f AS (SELECT event_id AS e, {sql_picked(SCENES, 'event_id')} AS scene, {sql_picked(ASKED, 'event_id // 2')} AS intent, {sql_picked(COMPLEX, 'event_id // 4')} AS cx,
  {sql_picked(NEED, 'event_id // 6')} AS need, {sql_picked(LENGTHS, 'event_id // 3')} AS len, {sql_picked(SOURCES, 'event_id // 5')} AS src FROM events),
errs AS (SELECT *, CASE WHEN e % 19 = 2 THEN ['unparsed:'] ELSE list_filter([
  CASE WHEN e % 17 = 0 THEN 'unknown_field:note' END,
  CASE WHEN scene = 'cooking' THEN 'bad_scene:' END,
  CASE WHEN scene <> 'cooking' AND NOT (intent = 'none' OR scene = 'reading') THEN 'bad_intent:' END,
  CASE WHEN scene <> 'cooking' AND cx = 'true' THEN 'not_number:complexity' WHEN scene <> 'cooking' AND cx = '1.5' THEN 'out_of_range:complexity' END,
  CASE WHEN scene <> 'cooking' AND need = '"no"' THEN 'not_boolean:need_cloud' END,
  CASE WHEN scene = 'none' AND e % 13 = 0 THEN 'unknown_slot:x' END,
  CASE WHEN scene = 'reading' AND len NOT IN ('120', '-3') THEN 'not_integer:text_length' END,
  CASE WHEN scene = 'reading' AND e % 7 = 0 THEN 'missing_slot:source' WHEN scene = 'reading' AND src = '"web"' THEN 'not_allowed:source' END
], lambda x: x IS NOT NULL) END AS errors FROM f)
"""


@query(f"WITH {DECISION_SQL} SELECT e AS event_id, array_to_string(errors, ' ') AS errors, len(errors) = 0 AS valid, CASE WHEN e % 19 <> 2 THEN scene END AS scene FROM errs")
def decision_errors(spark, sf_dir):
    """A decision's violations in order, from texts with fences, words around and nothing to parse."""
    rows = contract.with_decision(decision_texts(spark, sf_dir), "text")
    return rows.select("event_id", F.array_join("d.errors", " ").alias("errors"), decisions.is_valid(F.col("d")).alias("valid"), "d.scene")


@query(f"WITH {DECISION_SQL}, edge AS (SELECT e, CASE WHEN e % 19 < 3 THEN ['unparsed:'] WHEN scene = 'reading' AND len = '-3' THEN list_append(errors, 'negative:text_length') ELSE errors END AS errors FROM errs) SELECT e AS event_id, array_to_string(errors, ' ') AS errors FROM edge")
def decision_errors_edge(spark, sf_dir):
    """V3: the device's profile: the whole text must be one object; signs, lengths and blanks count."""
    rows = contract.with_decision(decision_texts(spark, sf_dir), "text", mode="strict", profile="edge")
    return rows.select("event_id", F.array_join("d.errors", " ").alias("errors"))


#: Labels by the event's id: scenes, intents, slots as JSON, checked fields.
LABEL_SCENES, LABEL_INTENTS, LABEL_SLOTS, LABEL_CHECKS = ("chat", "reading", "sea"), ("none", "rewrite"), ('{"goal": "拒绝"}', '{"source": "fax", "x": 1}', "[]", "{}"), ("scene", "slots.goal", "mood", "need_cloud", "")


@query(f"""
WITH l AS (SELECT event_id, {sql_picked(LABEL_SCENES, 'event_id')} AS scene, {sql_picked(LABEL_INTENTS, 'event_id // 3')} AS intent, {sql_picked(LABEL_SLOTS, 'event_id // 5')} AS slots,
  {sql_picked(LABEL_CHECKS, 'event_id // 7')} AS c, event_id % 2 = 0 AS cloud FROM events),
e AS (SELECT event_id, CASE WHEN scene = 'sea' THEN ['bad_scene:'] WHEN intent = 'rewrite' AND scene <> 'chat' THEN ['bad_intent:'] WHEN slots = '[]' THEN ['slots_not_object:'] ELSE list_filter([
  CASE WHEN slots LIKE '%goal%' AND scene <> 'chat' THEN 'unknown_slot:goal' WHEN slots LIKE '%fax%' THEN CASE WHEN scene = 'reading' THEN 'unknown_slot:x' ELSE 'unknown_slot:source,x' END END,
  CASE WHEN slots LIKE '%fax%' AND scene = 'reading' THEN 'not_allowed:source' END,
  CASE WHEN c = '' THEN 'no_checks:' WHEN c = 'mood' THEN 'unknown_check:mood' WHEN c = 'slots.goal' AND slots NOT LIKE '%goal%' THEN 'unlabelled:slots.goal' WHEN c = 'need_cloud' AND NOT cloud THEN 'unlabelled:need_cloud' END
], lambda x: x IS NOT NULL) END AS errors FROM l)
SELECT event_id, array_to_string(errors, ' ') AS errors FROM e
""")
def label_faults(spark, sf_dir):
    """V5: labels of which required slots may be missing, whose checks must be known and backed."""
    e = F.col("event_id")
    at = lambda values, by: picked(values, F.floor(e / by))
    checks_ = F.filter(F.array(at(LABEL_CHECKS, 7)), lambda c: c != "")
    rows = table(spark, sf_dir, "events").select("event_id", at(LABEL_SCENES, 1).alias("scene"), at(LABEL_INTENTS, 3).alias("intent"), F.when(e % 2 == 0, F.lit(True)).alias("need_cloud"), at(LABEL_SLOTS, 5).alias("slots"), checks_.alias("checks"))
    return contract.label_errors(rows).select("event_id", F.array_join("errors", " ").alias("errors"))


@query(f"WITH {DECISION_SQL} SELECT CASE WHEN errors[1] = '' THEN '' ELSE split_part(errors[1], ':', 1) END AS kind, count(*) AS n FROM errs WHERE len(errors) > 0 GROUP BY 1")
def decision_error_kinds(spark, sf_dir):
    """The first violation of each invalid decision."""
    rows = contract.with_decision(decision_texts(spark, sf_dir), "text").where(~decisions.is_valid(F.col("d")))
    return rows.groupBy(decisions.error_kind(F.get("d.errors", F.lit(0))).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {DECISION_SQL} SELECT CAST(k AS VARCHAR) AS id, unnest(list_filter([CASE WHEN e % 20 < 2 THEN 'unique_id' END, CASE WHEN len(errors) > 0 THEN 'target' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT e - e % 20 + CASE WHEN e % 20 = 1 THEN 0 ELSE e % 20 END AS k, * FROM errs)")
def training_rules(spark, sf_dir):
    """V8: ids that repeat (two of each twenty) and targets that break the contract."""
    e = F.col("event_id")
    rows = contract.with_decision(decision_texts(spark, sf_dir).select((e - F.when(e % 20 == 1, 1).otherwise(0)).cast("string").alias("id"), "text"), "text")
    return checks.training_violations(rows.select("id", "d.errors"))


@query("""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS d, lang AS family FROM documents WHERE doc_id < 150)
SELECT id, 'status' AS rule FROM r WHERE d % 10 = 0 UNION ALL SELECT id, 'note' FROM r WHERE d % 10 = 1 UNION ALL SELECT id, 'need_cloud' FROM r WHERE d % 10 = 2
UNION ALL SELECT id, 'family' FROM r WHERE d % 10 = 3 UNION ALL SELECT id, 'unique_text' FROM r WHERE d IN (44, 45)
""")
def review_rules(spark, sf_dir):
    """V6: a review sheet of 150 rows against its draft."""
    d = F.col("doc_id")
    draft = table(spark, sf_dir, "documents").where("doc_id < 150").select("doc_id", d.cast("string").alias("id"), F.col("lang").alias("family"))
    sheet = draft.select(
        "id",
        F.when(d % 10 == 0, "?").when(d % 10 == 1, "修正").otherwise("通过").alias("status"),
        F.lit(" ").alias("note"),
        F.when(d % 10 == 2, "maybe").otherwise(F.lit(None)).alias("need_cloud"),
        F.when(d % 10 == 3, "other").otherwise(F.col("family")).alias("family"),
        F.when(d == 45, "text 44").otherwise(F.concat(F.lit("text "), "id")).alias("norm"),
    )
    return checks.review_violations(sheet, draft.select("id", "family"))
