"""Row-level rules: routing, formatters, places, times, titles, evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import strip_spaces

#: Scene ids and their group.
SCENE_GROUPS = {
    "food": "food",
    "reading_text": "reading",
    "reading_image": "reading",
    "reading_pdf": "reading",
    "chat_reply": "chat",
    "chat_rewrite": "chat",
    "chat_context": "chat",
    "location": "location",
}
#: Municipalities are provinces of their own, by the first two digits of the code.
MUNICIPALITIES = ("11", "12", "31", "50")
ROUTE = {"accuracy": 0.85, "lambda_ms": 0.00025, "edge_ms": 220, "cloud_ms": 1200, "ceiling": 0.85}


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """A small dictionary with a default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def executor(kind: Column) -> Column:
    """Edge, or else cloud."""
    return F.when(kind == "edge", "edge").otherwise("cloud")


def route(ready: Column, preferred: Column, valid: Column, complexity: Column, confidence: Column, edge_ms: Column | None = None, cloud_ms: Column | None = None, *, target: float = ROUTE["accuracy"], per_ms: float = ROUTE["lambda_ms"]) -> Column:
    """struct(kind, reason) of the first rule that holds, from hard conditions to the confidence threshold.

    The threshold falls by ``per_ms`` for every millisecond that the edge saves.
    """
    edge_ms, cloud_ms = edge_ms if edge_ms is not None else F.lit(ROUTE["edge_ms"]), cloud_ms if cloud_ms is not None else F.lit(ROUTE["cloud_ms"])
    required = target - per_ms * F.greatest(F.lit(0), cloud_ms - edge_ms)
    say = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return (
        F.when(~ready, say("cloud", "not_ready"))
        .when(~preferred, say("cloud", "not_preferred"))
        .when(~F.coalesce(valid, F.lit(True)), say("cloud", "invalid"))
        .when(complexity > ROUTE["ceiling"], say("cloud", "too_complex"))
        .when(confidence.isNull(), say("cloud", "no_confidence"))
        .when(confidence >= required, say("edge", "confident"))
        .otherwise(say("cloud", "unsure"))
    )


def chosen_goal(explicit: Column, intent: Column, edge_goal: Column, unset: str = "不指定") -> Column:
    """The explicit goal, else the goal of a reply suggestion unless it is unset, else empty."""
    usable = (intent == "reply_suggest") & (edge_goal != unset)
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(usable, edge_goal), F.lit(""))


def error_class(status: Column) -> Column:
    """A class for an HTTP status."""
    return (
        F.when(status.isNull(), "network")
        .when(status.between(200, 299), "ok")
        .when(status.isin(401, 403), "auth")
        .when(status == 404, "missing")
        .when(status == 413, "too_large")
        .when(status == 422, "invalid")
        .when(status == 429, "limited")
        .when(status.isin(502, 503, 504), "upstream")
        .when(status >= 500, "server")
        .otherwise("client")
    )


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one place; a dash for null."""
    return F.when(ms.isNull(), "—").when(ms < 1000, F.format_string("%d ms", ms.cast("long"))).otherwise(F.format_string("%.1f s", ms / 1000.0))


def megabytes(size: Column) -> Column:
    """X27."""
    return F.when(size.isNull(), "—").otherwise(F.format_string("%.1f MB", size / 1048576.0))


def percent(value: Column) -> Column:
    """X27."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%d%%", F.round(value * 100).cast("long")))


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """How long ago, in the largest unit that fits; the date beyond a week."""
    s = F.floor((now_ms - then_ms) / 1000)
    return (
        F.when(s < 60, "刚刚")
        .when(s < 3600, F.format_string("%d 分钟前", F.floor(s / 60)))
        .when(s < 86400, F.format_string("%d 小时前", F.floor(s / 3600)))
        .when(s < 7 * 86400, F.format_string("%d 天前", F.floor(s / 86400)))
        .otherwise(F.date_format(F.timestamp_millis(then_ms), "MM-dd"))
    )


def title_of(text: Column, fallback: str, size: int = 24) -> Column:
    """P10: the first characters, or a fallback."""
    return F.coalesce(F.nullif(F.left(text, F.lit(size)), F.lit("")), F.lit(fallback))


def subtitle_of(parts: Column, most: int = 4) -> Column:
    """P10: the first parts joined."""
    return F.array_join(F.slice(parts, 1, most), "、")


def city_code(province: Column, city: Column, adcode: Column, district: Column) -> Column:
    """struct(code, name) of the city that a reverse-geocoded place is in; ``[]`` counts as missing.

    Municipalities go by their province, places with a city by its four digits, counties directly below a province
    by their own code.
    """
    text = lambda c: F.when(c.isNull() | (F.trim(c) == "") | (F.trim(c) == "[]"), F.lit(None)).otherwise(F.trim(c))
    here = F.substring(adcode, 1, 2)
    capital = here.isin(*MUNICIPALITIES)
    code = F.when(capital, F.concat(here, F.lit("0000"))).when(text(city).isNotNull(), F.concat(F.substring(adcode, 1, 4), F.lit("00"))).otherwise(adcode)
    name = F.when(capital, text(province)).otherwise(F.coalesce(text(city), text(district)))
    return F.when(adcode.rlike(r"^\d{6}$") & name.isNotNull(), F.struct(code.alias("code"), name.alias("name")))


def same_place(code: Column, adcode: Column) -> Column:
    """whether a point's district lies in a city: two digits for municipalities, all for counties below a province, else four."""
    same = lambda n: F.substring(code, 1, n) == F.substring(adcode, 1, n)
    return F.when(F.substring(code, 1, 2).isin(*MUNICIPALITIES), same(2)).when(F.substring(code, 3, 2) == "90", code == adcode).otherwise(same(4))


def map_search_url(base: str, code: Column, keyword: Column) -> Column:
    """X34."""
    return F.concat(F.lit(base + "?query="), F.url_encode(keyword), F.lit("&city="), code)


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """whether a minute of the day is in an interval that may wrap midnight; equal bounds are the whole day."""
    return F.when(start == end, F.lit(True)).when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def on_day(ts_ms: Column, day: Column, zone: str) -> Column:
    """whether an instant falls on a day of a zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)) == day


def good_fix(age_s: Column, accuracy_m: Column, max_age: int = 120, max_error: int = 3000) -> Column:
    """a location that is neither old, from the future, nor vague."""
    return age_s.between(0, max_age) & (accuracy_m <= max_error)


def private_host(host: Column) -> Column:
    """loopback, link-local and private IPv4 ranges, and local names."""
    p = F.split(host, r"\.")
    n = lambda i: F.try_to_number(F.get(p, F.lit(i)), F.lit("999")).cast("int")
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (n(0) == 10) | (n(0) == 127) | ((n(0) == 192) & (n(1) == 168)) | ((n(0) == 172) & n(1).between(16, 31)) | ((n(0) == 169) & (n(1) == 254))
    return F.coalesce((host == "localhost") | host.endswith(".local") | (v4 & inside), F.lit(False))


def page_title(html: Column) -> Column:
    """the text of the title element, trimmed; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_alive(status: Column, title: Column) -> Column:
    """answered, and not with a page that says it is missing."""
    return (status == 200) & ~F.lower(title).rlike("404|not found")


def evidence_supported(evidence: Column, source: Column) -> Column:
    """F8: whether the evidence, white space aside, is part of the source."""
    return (F.trim(evidence) != "") & F.contains(strip_spaces(source), strip_spaces(evidence))


def supported_due(due_at: Column, evidence: Column) -> Column:
    """The due time if it has offset +08:00 and the evidence states its very date, hour and minute; else null."""
    day = r"(20\d{2})[年/.-](\d{1,2})[月/.-](\d{1,2})日?"
    clock = r"(\d{1,2}):(\d{2})"
    part = lambda text, pattern, i: F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("9999")).cast("int")
    iso = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\+08:?00$"
    same = [part(due_at, iso, i + 1) == part(evidence, day, i + 1) for i in range(3)]
    same += [part(due_at, iso, i + 4) == part(evidence, clock, i + 1) for i in range(2)]
    real = F.try_to_timestamp(due_at).isNotNull()
    ok = due_at.rlike(iso) & real
    for s in same:
        ok = ok & F.coalesce(s, F.lit(False))
    return F.when(ok, due_at)


def action_card(title: Column, tasks: Column, source: Column, most: int = 5, fallback: str = "待办行动卡") -> Column:
    """The card with only the tasks whose evidence the source holds, at most the first five looked at."""
    cut = F.transform(
        F.slice(F.coalesce(tasks, F.array().cast("array<struct<title:string,evidence:string,due_at:string>>")), 1, most),
        lambda t: F.struct(F.left(F.trim(F.coalesce(t["title"], F.lit(""))), F.lit(80)).alias("title"), F.left(F.trim(F.coalesce(t["evidence"], F.lit(""))), F.lit(120)).alias("evidence"), t["due_at"].alias("due_at")),
    )
    kept = F.filter(cut, lambda t: (t["title"] != "") & F.coalesce(evidence_supported(t["evidence"], source), F.lit(False)))
    done = F.transform(kept, lambda t: F.struct(t["title"].alias("title"), supported_due(t["due_at"], t["evidence"]).alias("due_at"), t["evidence"].alias("evidence")))
    return F.struct(F.left(F.trim(F.coalesce(F.nullif(title, F.lit("")), F.lit(fallback))), F.lit(60)).alias("title"), done.alias("tasks"))


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes; null if it is none of those allowed."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png").when(head.startswith("255044462D"), "pdf")


def supervision_mask(prompt_len: Column, ids: Column, width: Column) -> Column:
    """Labels of a padded example: -100 for the prompt and the padding, ids elsewhere."""
    hidden = F.array_repeat(F.lit(-100), F.least(prompt_len, F.size(ids)))
    rest = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    return F.concat(hidden, rest, F.array_repeat(F.lit(-100), F.greatest(width - F.size(ids), F.lit(0))))


def offline_reply(goal: Column, style: Column, replies: dict[tuple[str, bool], str], polite: tuple[str, ...], default: str) -> Column:
    """A fixed reply by goal and by whether the style is one of the polite ones."""
    out = None
    for (name, is_polite), text in replies.items():
        here = (goal == name) & (style.isin(*polite) == F.lit(is_polite))
        out = F.when(here, text) if out is None else out.when(here, text)
    return out.otherwise(default) if out is not None else F.lit(default)
