"""Queries that judge, ground and expand what is derived from the driver's tables, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import coerce, decisions, records, signals, text
from siftline.operators import checks, contract, evaluate, expand, overlap, retrieval, traces
from siftline.plans.column_queries import ASKED, DECISION_SQL, decision_texts, picked, sql_picked
from siftline.plans.queries import OVERLAP_SQL, overlap_sides, query
from siftline.scratch import new_path, stored
from siftline.session import table
from siftline.sources import files
from siftline.streaming import logs

JUDGED_SQL = f"""
gold AS (SELECT event_id AS e, event_type AS family, CASE WHEN event_id % 3 = 0 THEN 'reading' WHEN event_id % 31 = 0 THEN 'location' ELSE 'none' END AS ws, CASE WHEN event_id % 3 = 0 THEN {sql_picked(ASKED, 'event_id // 3')} ELSE 'none' END AS wi FROM events),
pred AS (SELECT *, CASE WHEN e % 13 = 0 THEN 'none' ELSE ws END AS scene, {sql_picked(("0.25", "1", "0.75"), 'e // 4')} AS cx, CASE WHEN e % 9 = 0 THEN 'true' ELSE 'false' END AS need, e % 5 <> 0 AS src, e % 7 <> 0 AS len FROM gold),
judged AS (SELECT *, CASE WHEN scene = 'reading' AND e % 8 <> 1 THEN wi ELSE 'none' END AS intent, CASE ws WHEN 'reading' THEN 2 WHEN 'location' THEN 1 ELSE 0 END AS slots, CASE scene WHEN 'reading' THEN 2 WHEN 'location' THEN 1 ELSE 0 END AS given,
  CASE WHEN e % 19 = 2 THEN 'unparsed' WHEN e % 17 = 0 THEN 'unknown_field' WHEN scene = 'reading' AND e % 23 = 0 THEN 'missing_slot' END AS fault FROM pred),
j AS (SELECT *, fault IS NULL AS ok, fault IS NULL AND e % 19 >= 3 AS whole, CASE WHEN fault IS NOT NULL OR scene <> ws THEN 0 WHEN scene = 'reading' THEN CAST(src AS INT) + CAST(len AS INT) ELSE slots END AS hits FROM judged)
"""


def gold_and_predictions(spark, sf_dir):
    """id, family, expected, checks of every event; and what a model wrote for it, wrong in some ways."""
    e = F.col("event_id")
    fields = lambda scene, intent, complexity, cloud, slots: [F.lit('{"scene": "'), scene, F.lit('", "intent": "'), intent, F.lit('", "complexity": '), complexity, F.lit(', "confidence": 0.9, "need_cloud": '), cloud, F.lit(', "slots": '), slots]
    want = F.when(e % 3 == 0, "reading").when(e % 31 == 0, "location").otherwise("none")
    intent = F.when(e % 3 == 0, picked(ASKED, F.floor(e / 3))).otherwise("none")
    slots = lambda scene, reading: F.when(scene == "reading", reading).when(scene == "location", '{"place_type": "超市"}').otherwise("{}")
    expected = F.concat(*fields(want, intent, F.lit("0.25"), F.lit("false"), slots(want, F.lit('{"text_length": 120, "source": "text"}'))), F.lit("}"))
    asked = F.when(want == "reading", F.array(*map(F.lit, ("scene", "intent", "slots.source")))).otherwise(F.array(F.lit("scene"), F.lit("intent")))
    gold = table(spark, sf_dir, "events").select(e.cast("string").alias("id"), F.col("event_type").alias("family"), expected.alias("expected"), asked.alias("checks"))
    scene = F.when(e % 13 == 0, "none").otherwise(want)
    said = F.when((scene == "reading") & (e % 8 != 1), intent).otherwise("none")
    source = F.when(e % 23 == 0, "").otherwise(F.when(e % 5 == 0, ', "source": "pdf"').otherwise(', "source": "text"'))
    reading = F.concat(F.lit('{"text_length": '), F.when(e % 7 == 0, "90").otherwise("120"), source, F.lit("}"))
    body = F.concat(*fields(scene, said, picked(("0.25", "1", "0.75"), F.floor(e / 4)), F.when(e % 9 == 0, "true").otherwise("false"), slots(scene, reading)), F.when(e % 17 == 0, ', "note": 1}').otherwise("}"))
    wrapped = F.when(e % 19 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(e % 19 == 1, F.concat(F.lit("so "), body, F.lit(" ok"))).when(e % 19 == 2, F.lit("no answer")).otherwise(body)
    return gold, table(spark, sf_dir, "events").select(e.cast("string").alias("id"), wrapped.alias("text"))


@query(f"""
WITH {JUDGED_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND scene = ws) AS sc, count(*) FILTER (ok AND intent = wi) AS it,
  count(*) FILTER (ok AND need = 'false') AS cl, avg(CASE WHEN ok THEN abs(CAST(cx AS DOUBLE) - 0.25) END) AS mae, sum(hits) AS tp, sum(CASE WHEN ok THEN given - hits ELSE 0 END) AS fp,
  sum(slots - hits) AS fn, sum(CASE WHEN ok THEN slots ELSE 0 END) AS fields FROM j)
SELECT total, valid AS contract_valid, round(valid / total, 4) AS contract_valid_rate, round(sc / valid, 4) AS scene_accuracy, round(it / valid, 4) AS intent_accuracy, round(cl / valid, 4) AS need_cloud_accuracy,
  round(mae, 4) AS complexity_mae, round(tp / (tp + fp), 4) AS slot_precision, round(tp / (tp + fn), 4) AS slot_recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS slot_f1, round(tp / fields, 4) AS slot_field_accuracy FROM s
""")
def eval_lenient(spark, sf_dir):
    """A prediction may stand among other text; accuracies are over valid ones."""
    return evaluate.lenient(evaluate.judged(*gold_and_predictions(spark, sf_dir)))


@query(f"WITH {JUDGED_SQL} SELECT ws AS scene, count(*) AS n, round(count(*) FILTER (scene = ws AND intent = wi) / count(*), 4) AS accuracy FROM j WHERE ok GROUP BY ws")
def eval_by_scene(spark, sf_dir):
    """A6."""
    return evaluate.lenient_by_scene(evaluate.judged(*gold_and_predictions(spark, sf_dir)))


@query(f"WITH {JUDGED_SQL} SELECT fault AS kind, count(*) AS n FROM j WHERE NOT ok GROUP BY 1")
def eval_failures(spark, sf_dir):
    """The first violation of every prediction that is not valid."""
    return evaluate.failure_kinds(evaluate.judged(*gold_and_predictions(spark, sf_dir)))


def strictly(spark, sf_dir):
    return evaluate.strict_rows(evaluate.judged(*gold_and_predictions(spark, sf_dir), mode="strict"), ("scene", "intent", "slots.source"))


@query(f"""
WITH {JUDGED_SQL}, p AS (SELECT j.*, whole AND scene = ws AND intent = wi AND (ws <> 'reading' OR src) AS passed FROM j)
SELECT family, count(*) FILTER (passed) AS correct, count(*) AS total, round(count(*) FILTER (passed) / count(*), 4) AS rate, CASE WHEN family = 'view' THEN 0.95 ELSE 0.9 END AS target,
  count(*) FILTER (passed) / count(*) >= CASE WHEN family = 'view' THEN 0.95 ELSE 0.9 END AS passed FROM p GROUP BY family
""")
def eval_strict(spark, sf_dir):
    """The whole text must be the object; rates are over all rows."""
    return evaluate.strict_families(strictly(spark, sf_dir), ("view",))


@query(f"""
WITH {JUDGED_SQL}, field_counts AS (SELECT 'scene' AS field, count(*) FILTER (whole AND scene = ws) AS correct, count(*) AS total FROM j UNION ALL SELECT 'intent', count(*) FILTER (whole AND intent = wi), count(*) FROM j
  UNION ALL SELECT 'need_cloud', count(*) FILTER (whole AND need = 'false'), count(*) FROM j UNION ALL SELECT 'labeled_slots', CAST(sum(CASE WHEN whole THEN hits ELSE 0 END) AS BIGINT), CAST(sum(slots) AS BIGINT) FROM j)
SELECT field, correct, total, round(correct / total, 4) AS rate FROM field_counts
""")
def eval_strict_fields(spark, sf_dir):
    """A7."""
    return evaluate.strict_fields(strictly(spark, sf_dir))


def knowledge(spark, sf_dir):
    """A knowledge base of the documents: a city for each language."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("text != ''")
    return rows.select(
        d.alias("pos"), d.cast("string").alias("id"), F.col("lang").alias("city_code"), F.concat(F.upper("lang"), F.lit("市")).alias("city_name"), F.when(d % 2 == 0, "food").otherwise("sight").alias("kind"),
        F.left("text", F.lit(6)).alias("name"), "text", F.concat(F.lit("title "), "source").alias("source_title"), F.concat(F.lit("https://example.org/"), "source").alias("source_url"),
        F.concat(F.lit("2024-01-"), F.lpad((d % 28 + 1).cast("string"), 2, "0")).alias("verified_on"),
    )


def questions(spark, sf_dir):
    """The benchmark's items as questions; some ask for a kind, some for today, some of a city that is unknown."""
    i = F.col("item_id")
    more = F.when(i % 5 == 0, "美食").when(i % 5 == 1, "景点").when(i % 5 == 2, "今天").otherwise("")
    city = F.when(i % 4 < 2, "en").when(i % 4 == 2, "de").otherwise("xx")
    return table(spark, sf_dir, "benchmark").select(i.cast("string").alias("q"), city.alias("city_code"), F.concat(F.coalesce("text", F.lit("")), more).alias("question"))


KB_SQL = """
kb AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS city, CASE WHEN doc_id % 2 = 0 THEN 'food' ELSE 'sight' END AS kind, substr(text, 1, 6) AS name, regexp_extract_all(lower(substr(text, 1, 6) || ' ' || text), '[a-z0-9]+') AS t FROM documents WHERE text <> ''),
asks AS (SELECT *, replace(replace(question, upper(city) || '市', ''), upper(city), '') AS query FROM (SELECT CAST(item_id AS VARCHAR) AS q, item_id AS i, CASE WHEN item_id % 4 < 2 THEN 'en' WHEN item_id % 4 = 2 THEN 'de' ELSE 'xx' END AS city,
  coalesce(text, '') || CASE item_id % 5 WHEN 0 THEN '美食' WHEN 1 THEN '景点' WHEN 2 THEN '今天' ELSE '' END AS question, CASE item_id % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'sight' ELSE '' END AS asked FROM benchmark)),
terms AS (SELECT q, city, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS term FROM asks),
posts AS (SELECT city, id, len, term, count(*) AS tf FROM (SELECT city, id, len(t) AS len, unnest(t) AS term FROM kb) GROUP BY ALL),
df AS (SELECT city, term, count(*) AS df FROM posts GROUP BY ALL), st AS (SELECT city, count(*) AS n, avg(len(t)) AS a FROM kb GROUP BY city),
scored AS (SELECT q, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score, bool_or(length(term) >= 2) AS long
  FROM terms JOIN posts USING (city, term) JOIN df USING (city, term) JOIN st USING (city) GROUP BY ALL),
pairs AS (SELECT a.q, k.id, asked, kind, contains(question, name) AS named, coalesce(long, false) AS long, coalesce(score, 0) + CASE WHEN asked <> '' THEN 3 ELSE 0 END + CASE WHEN contains(question, name) THEN 8 ELSE 0 END AS total
  FROM asks a JOIN kb k ON k.city = a.city LEFT JOIN scored s ON s.q = a.q AND s.id = k.id),
best AS (SELECT q, id, round(total, 4) AS score, row_number() OVER (PARTITION BY q ORDER BY round(total, 4) DESC, id) AS rank FROM pairs
  WHERE total > 0.05 AND CASE WHEN asked <> '' THEN kind = asked ELSE named OR long END QUALIFY rank <= 4)
"""


@query(f"WITH {KB_SQL} SELECT q, id, round(score, 3) AS score, rank FROM best")
def kb_search(spark, sf_dir):
    """The four best items of a question's city."""
    found = retrieval.search(knowledge(spark, sf_dir), questions(spark, sf_dir))
    return found.select("q", "id", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {KB_SQL}, all_hits AS (SELECT q, list(id ORDER BY rank) AS hits FROM best GROUP BY q),
rows_ AS (SELECT a.q, a.i, EXISTS (SELECT 1 FROM kb WHERE kb.city = a.city) AS known, a.i % 5 = 2 AS live, CASE WHEN a.i % 5 <> 2 THEN hits END AS hits,
  CASE a.i % 7 WHEN 1 THEN list_filter([hits[2], hits[1]], lambda x: x IS NOT NULL) WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN ['none'] END AS ids FROM asks a LEFT JOIN all_hits h USING (q)),
cited AS (SELECT *, coalesce(ids IS NOT NULL AND (len(ids) = 0 OR (hits IS NOT NULL AND len(list_filter(ids, lambda x: NOT list_contains(hits, x))) = 0)), false) AS allowed FROM rows_),
c AS (SELECT *, CASE WHEN hits IS NULL THEN []::VARCHAR[] WHEN allowed THEN ids ELSE hits[1:3] END AS citations FROM cited)
SELECT q, CASE WHEN len(citations) = 0 THEN 'insufficient' WHEN allowed THEN 'rag' ELSE 'retrieval' END AS mode, len(citations) > 0 AS grounded,
  CASE WHEN NOT known THEN 'unknown_city' WHEN live THEN 'live' WHEN hits IS NULL THEN 'no_hit' WHEN allowed AND len(ids) = 0 THEN 'not_enough' END AS reason, array_to_string(citations, ',') AS citations FROM c
""")
def kb_answers(spark, sf_dir):
    """What is cited for each question, with what a model chose of the hits."""
    kb, asked = knowledge(spark, sf_dir), questions(spark, sf_dir)
    found = stored(retrieval.search(kb, asked), "hits")
    hits = found.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))
    i, none = F.col("q").cast("long"), F.array().cast("array<string>")
    two = F.array_compact(F.array(F.get("hits", F.lit(1)), F.get("hits", F.lit(0))))
    ids = F.when(i % 7 == 1, F.coalesce(two, none)).when(i % 7 == 2, none).when(i % 7 == 3, F.array(F.lit("none")))
    chosen = asked.join(hits, "q", "left").select("q", ids.alias("ids"))
    return retrieval.answers(kb, asked, chosen, found).select("q", "mode", "grounded", "reason", F.array_join("citations", ",").alias("citations"))


@query("""
WITH kb AS (SELECT doc_id AS pos, lang AS city_code, CASE WHEN doc_id % 2 = 0 THEN 'food' ELSE 'sight' END AS kind, substr(text, 1, 6) AS name, source, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS d FROM documents WHERE text <> '')
SELECT city_code, upper(city_code) || '市' AS city_name, array_to_string((list(name ORDER BY pos) FILTER (kind = 'food'))[1:3], '|') AS foods, array_to_string((list(name ORDER BY pos) FILTER (kind = 'sight'))[1:3], '|') AS sights,
  count(DISTINCT source) AS sources, max(d) AS updated_on FROM kb GROUP BY city_code
""")
def kb_guides(spark, sf_dir):
    """P11."""
    g = retrieval.guides(knowledge(spark, sf_dir))
    return g.select("city_code", "city_name", F.array_join("foods", "|").alias("foods"), F.array_join("sights", "|").alias("sights"), F.size("sources").cast("long").alias("sources"), "updated_on")


@query("""
WITH kb AS (SELECT CAST(doc_id - CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS id, CASE lang WHEN 'en' THEN '100000' WHEN 'de' THEN '200000' WHEN 'fr' THEN '300000' ELSE 'x' END AS code,
  CASE WHEN doc_id % 500 = 7 THEN 'other' ELSE 'N' || lang END AS city_name, doc_id AS d, text FROM documents),
names AS (SELECT code, count(DISTINCT city_name) AS k FROM kb GROUP BY code), ids AS (SELECT id, count(*) AS c FROM kb GROUP BY id)
SELECT id, unnest(list_filter([CASE WHEN trim(coalesce(CASE WHEN d % 13 = 0 THEN ' ' ELSE text END, '')) = '' THEN 'fields' END, CASE WHEN c > 1 THEN 'unique_id' END, CASE WHEN code = 'x' THEN 'city_code' END, CASE WHEN d % 11 = 0 THEN 'kind' END,
  CASE WHEN d % 17 = 0 THEN 'source_url' END, CASE WHEN d % 19 = 0 THEN 'verified_on' END, CASE WHEN k > 1 THEN 'one_name' END], lambda x: x IS NOT NULL)) AS rule FROM kb JOIN names USING (code) JOIN ids USING (id)
""")
def kb_violations(spark, sf_dir):
    """V7: items that break a rule: blanks, repeated ids, codes, kinds, sources, dates, two names of a city."""
    d = F.col("doc_id")
    code = F.when(F.col("lang") == "en", "100000").when(F.col("lang") == "de", "200000").when(F.col("lang") == "fr", "300000").otherwise("x")
    rows = table(spark, sf_dir, "documents").select(
        (d - F.when(d % 10 == 1, 1).otherwise(0)).cast("string").alias("id"), code.alias("city_code"), F.when(d % 500 == 7, "other").otherwise(F.concat(F.lit("N"), "lang")).alias("city_name"),
        F.when(d % 11 == 0, "shop").otherwise("food").alias("kind"), F.lit("n").alias("name"), F.when(d % 13 == 0, " ").otherwise(F.col("text")).alias("text"), F.lit("t").alias("source_title"),
        F.when(d % 17 == 0, "http://x").otherwise("https://example.org/x").alias("source_url"), F.when(d % 19 == 0, "2024-1-5").otherwise("2024-01-05").alias("verified_on"),
    )
    return checks.knowledge_violations(rows)


@query("""
WITH t AS (SELECT r_regionkey AS s, 0 AS tp, n_nationkey AS a, 0 AS b, r_name || ' ' || n_name || ' and ' || n_name AS text FROM region, nation
  UNION ALL SELECT r.r_regionkey, 1, n_nationkey, l.r_regionkey, n_name || ' ' || lower(l.r_name) FROM region r, nation, region l UNION ALL SELECT r_regionkey, 2, 0, 0, 'plain {other}' FROM region),
n AS (SELECT row_number() OVER (ORDER BY s, tp, a, b) AS seq, text FROM t)
SELECT printf('scene_%04d', seq) AS id, seq, text FROM n
""")
def template_expansion(spark, sf_dir):
    """A region's templates with every nation and every region's name."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    templates = F.array(F.concat("r_name", F.lit(" {nation} and {nation}")), F.lit("{nation} {small}"), F.lit("plain {other}"))
    specs = region.select(F.col("r_regionkey").cast("int").alias("spec_pos"), F.col("r_name").alias("scene"), templates.alias("templates"))
    words = nation.select(F.lit("nation").alias("name"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value")).unionAll(region.select(F.lit("small"), "r_regionkey", F.lower("r_name")))
    return expand.expand(specs, words).select("id", "seq", "text")


@query("SELECT event_id, event_id % 6 <> 4 AS parsed, event_id % 6 NOT IN (4, 6) AS is_object FROM events")
def json_salvage(spark, sf_dir):
    """Objects in fences, in prose, with commas too many, with braces in strings, before the start of another."""
    e = F.col("event_id")
    of = lambda mark: F.concat(F.lit(mark.split("@")[0]), e.cast("string"), F.lit(mark.split("@")[1]))
    forms = ['```json\n{"a": @}\n```', 'sure: {"a": @} ok', '{"a": [@, 2,],}', '{"a": "}{", "b": @} x', "no object @", '{"a": {"b": @}} {"c"']
    texts = F.element_at(F.array(*map(of, forms)), (e % 6 + 1).cast("int"))
    rows = contract.with_decision(table(spark, sf_dir, "events").select("event_id", texts.alias("t")), "t")
    return rows.select("event_id", "d.parsed", "d.is_object")


#: Places as a geocoder gives them: province, city, district code, district.
PLACES = (("北京市", "[]", "110108", "海淀区"), ("湖北省", "[]", "429004", "仙桃市"), ("湖北省", "武汉市", "420106", "武昌区"), ("重庆市", "", "500103", "渝中区"), ("广东省", "深圳市", "44x305", "南山区"))


@query(f"""
WITH p AS (SELECT c_custkey, {", ".join(f"{sql_picked(tuple(x[i] for x in PLACES), 'c_custkey')} AS {n}" for i, n in enumerate(("p", "c", "a", "d")))} FROM customer)
SELECT c_custkey, CASE WHEN a LIKE '%x%' THEN NULL WHEN substr(a, 1, 2) IN ('11', '12', '31', '50') THEN substr(a, 1, 2) || '0000' WHEN c NOT IN ('', '[]') THEN substr(a, 1, 4) || '00' ELSE a END AS code,
  CASE WHEN a LIKE '%x%' THEN NULL WHEN substr(a, 1, 2) IN ('11', '12', '31', '50') THEN p WHEN c NOT IN ('', '[]') THEN c ELSE d END AS name FROM p
""")
def place_codes(spark, sf_dir):
    """J7."""
    k = F.col("c_custkey")
    parts = [picked(tuple(x[i] for x in PLACES), k) for i in range(4)]
    return table(spark, sf_dir, "customer").select("c_custkey", records.city_code(*parts).alias("x")).select("c_custkey", "x.code", "x.name")


@query("SELECT doc_id, round(1 - pow(1 - pow(s, 4), 32), 9) AS hit FROM (SELECT doc_id, (n_chars % 21) / 20.0 AS s FROM documents)")
def lsh_curve(spark, sf_dir):
    """X11: the chance that bands of four rows meet, by a similarity taken from the document's length."""
    s = F.pmod("n_chars", F.lit(21)) / 20.0
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.lsh_hit_probability(s, 4, 32), 9).alias("hit"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def id_differences(spark, sf_dir):
    """How the ids of predictions differ from those asked."""
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("id"))
    return files.id_differences(ids("labels"), ids("documents"))


@query(r"SELECT b.item_id AS id, d.doc_id AS ref FROM benchmark b JOIN documents d ON regexp_replace(lower(nfc_normalize(b.text)), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(lower(nfc_normalize(d.text)), '[^\p{L}\p{N}]', '', 'g')")
def overlap_exact_normal(spark, sf_dir):
    """Equal after NFKC (the given texts hold no compatibility characters, so NFC gives the same)."""
    sides = [overlap.normalised(table(spark, sf_dir, name), id_col=key, text="text") for name, key in (("benchmark", "item_id"), ("documents", "doc_id"))]
    return overlap.exact_matches(*sides).select(F.col("id").cast("long").alias("id"), F.col("ref").cast("long").alias("ref"))


@query("SELECT event_id, round(value) AS whole, CAST(floor(value) AS BIGINT) AS low FROM events WHERE value IS NOT NULL AND abs(value - floor(value) - 0.5) > 1e-9")
def rounded_values(spark, sf_dir):
    """Rounding, away from ties."""
    v = F.col("value")
    return table(spark, sf_dir, "events").where((F.abs(v - F.floor(v) - 0.5) > 1e-9) & v.isNotNull()).select("event_id", F.round(v).alias("whole"), F.floor(v).alias("low"))


@query("SELECT event_id, is_valid FROM (SELECT e AS event_id, len(errors) = 0 AS is_valid FROM (WITH " + DECISION_SQL + " SELECT * FROM errs)) WHERE is_valid")
def valid_decisions(spark, sf_dir):
    """V2."""
    rows = contract.with_decision(decision_texts(spark, sf_dir), "text").where(decisions.is_valid(F.col("d")))
    return rows.select("event_id", F.lit(True).alias("is_valid"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def bounded_event_log(spark, sf_dir):
    """K14, ST5, ST7: events as a stream of files, logged with a limit of 200 rows."""
    source, log = new_path(spark, "event-files"), new_path(spark, "event-log")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    rows.repartitionByRange(6, "seq").write.parquet(source)
    kind = "event_id long, user_id long, ts long, seq long"
    logs.bounded_log(logs.replayed(spark, source, kind, files_per_batch=2), log, new_path(spark, "event-log-state"), 200).awaitTermination()
    return logs.read_bounded(spark, log).select("event_id", "user_id")


@query("SELECT doc_id, replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ') AS cell, list_filter(list_transform(string_split(left(text, 60), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL AND text LIKE '%,%' AND left(text, 60) LIKE '%,%'")
def clean_cells(spark, sf_dir):
    """Texts as cells of a TSV, and their first characters split at commas."""
    rows = table(spark, sf_dir, "documents").where(F.left("text", F.lit(60)).contains(","))
    return rows.select("doc_id", text.clean_cell(F.col("text")).alias("cell"), text.split_list(F.left("text", F.lit(60))).alias("parts"))


@query(f"""
WITH {OVERLAP_SQL}, exact AS (SELECT b.id, d.ref FROM b JOIN d USING (norm)),
scored AS (SELECT id, ref, CAST(shared AS DOUBLE) / (np + nr - shared) AS jaccard FROM shared WHERE least(np, nr) >= 0.2 * greatest(np, nr) AND id NOT IN (SELECT id FROM exact))
SELECT 'EXACT' AS kind, id, ref, '1.000' AS score FROM exact
UNION ALL SELECT 'NEAR', id, ref, printf('%.3f', jaccard) FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, ref) = 1 AND jaccard >= 0.2
""")
def overlap_rows(spark, sf_dir):
    """K9: the rows of an overlap report."""
    return overlap.overlap_report(*overlap_sides(spark, sf_dir), threshold=0.2, cap=None)


@query("SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def public_customers(spark, sf_dir):
    """The allowed fields of a struct, in order of name."""
    rows = table(spark, sf_dir, "customer")
    held = rows.select(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.lit("secret").alias("hidden")).alias("x"))
    out = files.public_fields(held, {"x": ["segment", "key", "balance"]})
    return out.select(F.col("x.key").alias("c_custkey"), "x.segment", "x.balance")


@query(f"""
WITH {DECISION_SQL} SELECT e AS event_id, scene || '|' || intent || '|' || CASE WHEN e % 100 < 34 THEN 'easy' WHEN e % 100 < 67 THEN 'medium' ELSE 'hard' END || '|' ||
  CASE WHEN scene = 'reading' THEN CASE WHEN e % 7 = 0 THEN 'text_length' ELSE 'source+text_length' END WHEN e % 13 = 0 THEN 'x' ELSE '-' END AS cell FROM errs WHERE e % 19 <> 2
""")
def decision_cells(spark, sf_dir):
    """P5: scene, intent, band and slot names of each decision that parses."""
    rows = contract.with_decision(decision_texts(spark, sf_dir), "text").where("d.is_object")
    hard = signals.band((F.col("event_id") % 100) / 100.0)
    return rows.select("event_id", decisions.cell(F.col("d.scene"), F.col("d.intent"), hard, F.col("d.slots")).alias("cell"))


@query("""
SELECT item_id, '<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'S' || item_id || ': ' || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM benchmark WHERE text IS NOT NULL
""")
def chat_prompts(spark, sf_dir):
    """A template filled in and wrapped for chat."""
    asked = decisions.prompt(F.concat(F.lit("S"), F.col("item_id").cast("string")), F.col("text"), "{signals}: {utterance}")
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", decisions.chat_wrap("be brief", asked).alias("prompt"))


@query("SELECT event_id, 'k：' || substr(props, 7, length(props) - 7) AS said, ['k：' || substr(props, 7, length(props) - 7)] AS listed, 'user ' || user_id AS content FROM events WHERE props LIKE '{\"k\": %}'")
def loose_values(spark, sf_dir):
    """JSON objects as text and as lists of text, message content from parts."""
    rows = table(spark, sf_dir, "events").where("props LIKE '{\"k\": %}'")
    parts = F.concat(F.lit('["user ", {"text": "'), F.col("user_id").cast("string"), F.lit('"}, {"image": 1}]'))
    return rows.select("event_id", coerce.json_text(F.col("props")).alias("said"), coerce.json_list(F.col("props")).alias("listed"), coerce.json_content(parts).alias("content"))


@query("""
SELECT CASE lang WHEN 'en' THEN '100000' WHEN 'de' THEN '200000' WHEN 'fr' THEN '300000' ELSE '400000' END AS city_code, CASE WHEN doc_id % 2 = 0 THEN 'food' ELSE 'sight' END AS kind, count(*) AS n, min(doc_id) AS first
FROM documents WHERE trim(text) <> '' GROUP BY ALL
""")
def knowledge_file(spark, sf_dir):
    """A knowledge base as a file, written, read with its checks, and counted."""
    path, d = new_path(spark, "knowledge"), F.col("doc_id")
    code = F.when(F.col("lang") == "en", "100000").when(F.col("lang") == "de", "200000").when(F.col("lang") == "fr", "300000").otherwise("400000")
    texts = {"city_name": F.concat(F.lit("N"), code), "name": F.lit("n"), "source_title": F.lit("t"), "source_url": F.lit("https://example.org/x"), "verified_on": F.lit("2024-01-05")}
    rows = table(spark, sf_dir, "documents").where("trim(text) != ''").select(d.cast("string").alias("id"), code.alias("city_code"), F.when(d % 2 == 0, "food").otherwise("sight").alias("kind"), "text", *[x.alias(n) for n, x in texts.items()])
    files.write_jsonl(rows, path)
    kb = files.knowledge_base(spark, path)
    return kb.groupBy("city_code", "kind").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'with pleasure' ELSE 'ok' END WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'so sorry' ELSE 'no' END ELSE 'noted' END AS reply, 'm' AS model, event_id % 900 AS latency_ms, round(0.5 + (event_id % 7) / 20.0, 4) AS confidence FROM events")
def offline_replies(spark, sf_dir):
    """Fixed replies by goal and style, with what describes them."""
    e = F.col("event_id")
    replies = {("click", True): "with pleasure", ("click", False): "ok", ("error", True): "so sorry", ("error", False): "no"}
    style = F.when(F.col("user_id") % 2 == 0, "polite").otherwise("plain")
    meta = traces.response_meta(F.lit("m"), e % 900, F.array(F.lit("offline")), 0.5 + (e % 7) / 20.0, F.lit("none"))
    rows = table(spark, sf_dir, "events").select("event_id", records.offline_reply(F.col("event_type"), style, replies, ("polite",), "noted").alias("reply"), meta.alias("x"))
    return rows.select("event_id", "reply", "x.model", "x.latency_ms", F.col("x.confidence").alias("confidence"))
