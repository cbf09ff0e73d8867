"""The decision contract on the JVM: VARIANT values, a dimension table of rules, column expressions.

``try_parse_json`` reads a text as one typed value, ``schema_of_variant`` tells what kind each part is, and the scene joins
the table of its intents and slots.  Only texts that this does not settle go to Python's salvage: those that are no
JSON, that repeat a key, or whose slots hold other than texts, lists of texts, whole numbers, booleans and nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.decisions import DECISION, FIELDS, INTENTS, MOST_ITEMS, MOST_REASON, MOST_TOPIC, SLOTS, decision
from siftline.scratch import stored

RULES = "scene string, intents array<string>, slots array<struct<name:string,kind:string,required:boolean,allowed:array<string>>>"
MAP = "'map<string,variant>'"
#: Text that JSON's readers treat alike: no long runs of digits, no escaped control characters.
ODD = r"[0-9]{19}|\\u00[01]"


def contract_table(spark: SparkSession) -> DataFrame:
    """One row for each scene: its intents and its slots (name, kind, required, allowed values)."""
    rows = [(scene, list(intents), [(name, kind, required, list(allowed) if allowed else None) for name, (kind, required, allowed) in SLOTS[scene].items()]) for scene, intents in INTENTS.items()]
    return spark.createDataFrame(rows, RULES)


def kind(x: str) -> str:
    """SQL: what a variant is; null if there is none."""
    return f"schema_of_variant({x})"


def whole_json(t: str) -> str:
    """SQL: the value of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value.  So the text is parsed as a field, with one after it that it cannot name.
    """
    fields = f"""try_variant_get(try_parse_json(concat('{{"v":', {t}, ',"', md5({t}), '":0}}')), '$', {MAP})"""
    return f"element_at(transform(array({fields}), m -> IF(size(m) = 2 AND map_contains_key(m, md5({t})), element_at(m, 'v'), NULL)), 1)"


def text_of(x: str) -> str:
    return f"IF({kind(x)} = 'STRING', try_variant_get({x}, '$', 'string'), NULL)"


def is_number(x: str) -> str:
    return f"({kind(x)} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)')"


def items(x: str) -> str:
    return f"try_variant_get({x}, '$', 'array<variant>')"


def all_texts(x: str) -> str:
    """SQL: whether a variant is a list of texts alone."""
    return f"({kind(x)} LIKE 'ARRAY<%' AND forall({items(x)}, e -> {kind('e')} = 'STRING'))"


def blank(x: str) -> str:
    return rf"coalesce(try_variant_get({x}, '$', 'string') RLIKE '(?U)^[\\s\\x1c-\\x1f]*$', false)"


#: A variant as Python's JSON writer has it.
WRITTEN = f"IF({kind('e.value')} LIKE 'ARRAY<%', concat('[', array_join(transform({items('e.value')}, i -> to_json(i)), ', '), ']'), to_json(e.value))"
PAIRS = f"IF({kind('e.value')} LIKE 'ARRAY<%', transform({items('e.value')}, i -> concat(e.key, '=', to_json(i))), array(concat(e.key, '=', to_json(e.value))))"
SIMPLE = f"({kind('x')} IN ('STRING', 'BIGINT', 'BOOLEAN', 'VOID') OR {all_texts('x')})"


def slot_errors(partial: bool, slots: str = "_sm", rules: str = "_r.slots") -> str:
    """SQL: the faults of slots (a map of variants) by the scene's rules, in the rules' order, nulls between."""
    x = f"element_at({slots}, r.name)"
    missing = "NULL" if partial else "IF(r.required, concat('missing_slot:', r.name), NULL)"
    return f"""transform({rules}, r -> CASE
        WHEN NOT map_contains_key({slots}, r.name) THEN {missing}
        WHEN r.kind = 'strings' THEN CASE WHEN NOT {all_texts(x)} THEN concat('not_strings:', r.name) WHEN size({items(x)}) > {MOST_ITEMS} THEN concat('too_many:', r.name) END
        WHEN r.kind = 'enum' THEN IF(coalesce(array_contains(r.allowed, {text_of(x)}), false), NULL, concat('not_allowed:', r.name))
        WHEN r.kind = 'integer' THEN IF({kind(x)} = 'BIGINT', NULL, concat('not_integer:', r.name))
        ELSE IF({kind(x)} = 'STRING', NULL, concat('not_string:', r.name)) END)"""


def unknown(what: str, keys: str, known: str) -> str:
    """SQL: the fault that names keys beyond the known ones, or null."""
    extra = f"array_sort(array_except({keys}, {known}))"
    return f"IF(size({extra}) > 0, concat('unknown_{what}:', array_join({extra}, ',')), NULL)"


def edge_errors() -> str:
    """SQL: the device's further limits: lengths, signs, blanks, a reason that is text."""
    reason, topic, length = "element_at(_top, 'reason')", "element_at(_sm, 'topic')", "element_at(_sm, 'text_length')"
    inside = "array_compact(transform(_order, k -> IF({test}, concat('blank:', k), NULL)))"
    x = "element_at(_sm, k)"
    return f"""concat(array(
        IF(map_contains_key(_top, 'reason') AND NOT coalesce(char_length({text_of(reason)}) <= {MOST_REASON}, false), 'too_long:reason', NULL),
        IF(char_length({text_of(topic)}) > {MOST_TOPIC}, 'too_long:topic', NULL),
        IF({is_number(length)} AND try_variant_get({length}, '$', 'double') < 0, 'negative:text_length', NULL)),
        {inside.format(test=f"{kind(x)} = 'STRING' AND {blank(x)}")},
        {inside.format(test=f"{kind(x)} LIKE 'ARRAY<%' AND exists({items(x)}, i -> {kind('i')} = 'STRING' AND {blank('i')})")})"""


def contract_errors(profile: str, partial: bool) -> str:
    """SQL: the violations of a parsed object in the contract's order (V1, V3, V5)."""
    fields = ", ".join(f"'{f}'" for f in FIELDS)
    share = lambda n: f"CASE WHEN NOT coalesce({is_number(n)}, false) THEN 'not_number:{{0}}' WHEN NOT try_variant_get({n}, '$', 'double') BETWEEN 0 AND 1 THEN 'out_of_range:{{0}}' END"
    at = lambda name: f"element_at(_top, '{name}')"
    head = unknown("field", "map_keys(_top)", f"array({fields})")
    body = ", ".join(
        [
            f"IF(coalesce(array_contains(_r.intents, {text_of(at('intent'))}), false), NULL, 'bad_intent:')",
            *(share(at(n)).format(n) for n in ("complexity", "confidence")),
            f"IF(coalesce({kind(at('need_cloud'))} = 'BOOLEAN', false), NULL, 'not_boolean:need_cloud')",
        ]
    )
    rest = f"concat(array({unknown('slot', 'map_keys(_sm)', 'transform(_r.slots, r -> r.name)')}), {slot_errors(partial)})"
    if profile == "edge":
        rest = f"concat({rest}, {edge_errors()})"
    return f"""array_compact(CASE
        WHEN _top IS NULL THEN array('not_object:')
        WHEN _r.scene IS NULL THEN array({head}, 'bad_scene:')
        WHEN _sm IS NULL THEN array({head}, {body}, 'slots_not_object:')
        ELSE concat(array({head}, {body}), {rest}) END)"""


def with_decision(df: DataFrame, text: str, *, name: str = "d", mode: str = "salvage", profile: str = "server", partial: bool = False) -> DataFrame:
    """``df`` with the typed decision that its column ``text`` holds, as :func:`decisions.decision` gives it.

    Rows whose text is one JSON value are settled here; only the others pass through the Python function.  Which are
    which is found in one pass that is written: as a filter of two branches, every text would be parsed anew for each use of
    its value.  Null text does not parse.  No rows give no rows.
    """
    read = df.withColumn("_t", F.btrim(text, F.lit(" \t\n\r"))).withColumn("_v", F.expr(whole_json("_t")))
    read = read.withColumn("_top", F.expr(f"IF({kind('_v')} LIKE 'OBJECT<%', try_variant_get(_v, '$', {MAP}), NULL)"))
    slots = "element_at(_top, 'slots')"
    read = read.withColumn("_sm", F.expr(f"IF({kind(slots)} LIKE 'OBJECT<%', try_variant_get({slots}, '$', {MAP}), NULL)"))
    settled = F.expr(f"_v IS NOT NULL AND NOT _t RLIKE '{ODD.replace(chr(92), chr(92) * 2)}' AND coalesce(forall(map_values(_sm), x -> {SIMPLE}), true)")
    rules = F.broadcast(contract_table(df.sparkSession)).select(F.col("scene").alias("_scene"), F.struct("scene", "intents", "slots").alias("_r"))
    read = read.withColumn("_settled", F.coalesce(settled, F.lit(False))).withColumn("_s", F.expr(f"""IF(_settled, {text_of("element_at(_top, 'scene')")}, NULL)"""))
    plain = read.join(rules, read._s == rules._scene, "left").withColumn("_order", F.expr("json_object_keys(get_json_object(_t, '$.slots'))"))
    number = lambda n: f"IF({is_number(n)}, try_variant_get({n}, '$', 'double'), NULL)"
    cloud, held = "element_at(_top, 'need_cloud')", "coalesce(_sm, map())"
    value = F.expr(f"""named_struct('parsed', true, 'is_object', _top IS NOT NULL, 'scene', _s, 'intent', {text_of("element_at(_top, 'intent')")},
        'complexity', {number("element_at(_top, 'complexity')")}, 'confidence', {number("element_at(_top, 'confidence')")},
        'need_cloud', IF({kind(cloud)} = 'BOOLEAN', try_variant_get({cloud}, '$', 'boolean'), NULL),
        'slots', IF(_sm IS NULL, CAST(map() AS MAP<STRING, STRING>), map_from_entries(transform(map_entries(_sm), e -> struct(e.key, {WRITTEN})))),
        'pairs', IF(_sm IS NULL, CAST(array() AS ARRAY<STRING>), array_sort(array_distinct(flatten(transform(map_entries(_sm), e -> {PAIRS}))))),
        'errors', {contract_errors(profile, partial)})""").cast(DECISION)
    keep = [F.col(f"`{c}`") for c, kind in df.dtypes if c != name and kind != "void"]
    done = stored(plain.select(*keep, *([F.col(text).alias("_own")] if text == name else []), F.when(F.col("_settled"), value).alias("_d")), "decisions")
    back = [F.lit(None).alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in df.dtypes if c != name]  # files hold no column of nulls alone
    rest = decision(F.col("_own" if text == name else text), mode, profile, partial)
    return done.where("_d IS NOT NULL").select(*back, F.col("_d").alias(name)).unionAll(done.where("_d IS NULL").select(*back, rest.alias(name)))


def label_errors(df: DataFrame, *, slots: str = "slots", checks: str = "checks") -> DataFrame:
    """V5: ``df`` (scene, intent, need_cloud, slots as JSON, checks as a list) with ``errors``, the faults of its labels.

    Required slots may be missing; checked fields must be known and have a label.  Slots that are no JSON object, an unknown
    scene or an intent of another scene end the list, as nothing can be held against them.
    """
    rules = F.broadcast(contract_table(df.sparkSession)).select(F.col("scene").alias("_scene"), F.struct("scene", "intents", "slots").alias("_r"))
    read = df.join(rules, df.scene == rules._scene, "left").withColumn("_v", F.expr(whole_json(f"`{slots}`")))
    read = read.withColumn("_sm", F.expr(f"IF({kind('_v')} LIKE 'OBJECT<%', try_variant_get(_v, '$', {MAP}), NULL)")).withColumn("_checks", F.col(checks))
    known = "f IN ('scene', 'intent', 'need_cloud') OR f LIKE 'slots.%'"
    checked = f"""IF(coalesce(size(_checks), 0) < 1, array('no_checks:'), transform(_checks, f -> CASE
        WHEN NOT ({known}) THEN concat('unknown_check:', f)
        WHEN f LIKE 'slots.%' AND NOT map_contains_key(_sm, substr(f, 7)) THEN concat('unlabelled:', f)
        WHEN f = 'need_cloud' AND need_cloud IS NULL THEN 'unlabelled:need_cloud' END))"""
    errors = F.expr(f"""array_compact(CASE
        WHEN _r.scene IS NULL THEN array('bad_scene:')
        WHEN NOT coalesce(array_contains(_r.intents, intent), false) THEN array('bad_intent:')
        WHEN _sm IS NULL THEN array('slots_not_object:')
        ELSE concat(array({unknown('slot', 'map_keys(_sm)', 'transform(_r.slots, r -> r.name)')}), {slot_errors(True)}, {checked}) END)""")
    return read.select(*[F.col(f"`{c}`") for c in df.columns], errors.alias("errors"))
