"""BM25 retrieval over a knowledge base, with intent filters, refusal, citations and guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.functions.text import retrieval_tokens, searchable, without_place
from siftline.scratch import stored

K1, B = 1.2, 0.75
#: Words of a question that ask for food, for sights, and for what changes by the hour.
FOOD = ("美食", "小吃", "吃", "味道", "菜", "早餐")
SIGHT = ("景点", "逛", "玩", "游览", "风景", "地标")
LIVE = ("票价", "多少钱", "价格", "营业", "开门", "闭馆", "几点", "天气", "排队", "人多", "路况", "怎么去", "路线", "导航", "预约", "电话", "今天", "明天", "现在", "实时")
KIND_BOOST, NAME_BOOST, LEAST_SCORE, LIMIT, CITED = 3.0, 8.0, 0.05, 4, 3
#: Blocks of a term's postings; heaviest postings of a term, for each result asked, that give the first bound; allowance
#: for the rounding of scores to four places.
BLOCKS, CHAMPIONS, SLACK = 16, 8, 1e-4


def live_question(question: Column) -> Column:
    """whether a question asks for what the knowledge base cannot know."""
    return question.rlike("|".join(LIVE))


def asked_kind(query: Column) -> Column:
    """food or sight if just one of them is asked for, else empty."""
    food, sight = query.rlike("|".join(FOOD)), query.rlike("|".join(SIGHT))
    return F.when(food & ~sight, "food").when(sight & ~food, "sight").otherwise("")


def postings(docs: DataFrame, *, group: str, doc: str, text: Column, terms: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """grp, doc, length, term, the columns ``more`` and tf for every term of every document, or only for those of ``terms`` (grp, term)."""
    tokens = docs.select(F.col(group).alias("grp"), F.col(doc).alias("doc"), *more, retrieval_tokens(F.coalesce(text, F.lit(""))).alias("t"))
    rows = tokens.select("grp", "doc", *more, F.size("t").alias("length"), F.explode("t").alias("term"))
    if terms is not None:
        rows = rows.join(terms, ["grp", "term"], "left_semi")
    return rows.groupBy("grp", "doc", *more, "length", "term").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, *, group: str, text: Column) -> DataFrame:
    """group, n (documents), avg_length."""
    sized = docs.select(F.col(group).alias("grp"), F.size(retrieval_tokens(F.coalesce(text, F.lit("")))).alias("length"))
    return sized.groupBy("grp").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def bm25(tf: Column, df: Column, n: Column, length: Column, avg: Column) -> Column:
    """One term's part of the score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def weighed(docs: DataFrame, terms: DataFrame, *, group: str, doc: str, text: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """grp, term, doc, part, long and the columns ``more`` of documents: the postings of ``terms`` (grp, term), weighed, written.

    ``part`` is what the term adds to the document's score in its group's own statistics; ``long`` tells whether the term
    has two characters or more.
    """
    asked = small(stored(terms.distinct(), "terms"), 48)
    posts = stored(postings(docs, group=group, doc=doc, text=text, terms=asked, more=more), "postings")
    df = small(stored(posts.groupBy("grp", "term").agg(F.count("*").alias("df")), "frequencies"), 48)
    stats = small(stored(statistics(docs, group=group, text=text), "statistics"), 48)
    part = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("avg_length"))
    out = posts.join(df, ["grp", "term"]).join(stats, "grp").select("grp", "term", "doc", part.alias("part"), (F.char_length("term") >= 2).alias("long"), *more)
    return stored(out, "weighed")


def scores(docs: DataFrame, queries: DataFrame, *, group: str, doc: str, text: Column) -> DataFrame:
    """q, doc, score, long_match: sums over the queries' distinct terms (q, grp, terms), for every document that shares one."""
    terms = queries.select("q", "grp", F.explode(F.array_distinct("terms")).alias("term"))
    posts = weighed(docs, terms.select("grp", "term"), group=group, doc=doc, text=text)
    # postings are dealt by document, so that a document's scores are added up where it lies: they move, not the pairs
    met = posts.repartition("doc").join(small(stored(terms, "asked"), 64), ["grp", "term"])
    return met.groupBy("q", "doc").agg(F.sum("part").alias("score"), F.max("long").alias("long_match"))


def best_scores(posts: DataFrame, queries: DataFrame, k: int, *, fits: Column | None = None, eligible: Column | None = None, blocks: int = BLOCKS, champions: int = CHAMPIONS) -> DataFrame:
    """Q, doc, score, long_match for all documents that can be among a query's ``k`` best, by bounds on their scores.

    ``posts`` are :func:`weighed` postings, ``queries`` q, grp, terms and what ``fits`` reads; ``fits`` is a condition on a query
    and a posting, ``eligible`` one on ``long_match`` and the query's columns for documents that may be returned.

    A term's postings are cut into blocks by weight; each block and each term has a maximum.  The heaviest postings of
    every term give a score that k eligible documents reach.  With it, terms that together stay below it bring in no
    document of their own, blocks whose maximum with those of all other terms stays below it are not read, and of
    the documents that the other terms bring in only those are completed whose bound reaches it.  No document that belongs
    to the k best is lost, ties with the k-th included.
    """
    fits, eligible = F.lit(True) if fits is None else fits, F.lit(True) if eligible is None else eligible
    own = [c for c in queries.columns if c not in ("q", "grp", "terms")]
    tops = posts.groupBy("grp", "term").agg(F.max("part").alias("most"))
    cut = posts.join(small(stored(tops, "tops"), 48), ["grp", "term"]).withColumn("block", F.least(F.lit(blocks - 1), F.floor((1 - F.col("part") / F.col("most")) * blocks)).cast("int"))
    cut = stored(cut.drop("most"), "blocks")
    sizes = stored(cut.groupBy("grp", "term", "block").agg(F.max("part").alias("top")), "maxima")
    asked = queries.select("q", "grp", *own, F.explode(F.array_distinct("terms")).alias("term"))
    of_q = W.partitionBy("q")
    asked = stored(asked.join(sizes.groupBy("grp", "term").agg(F.max("top").alias("most")), ["grp", "term"]).withColumn("rest", F.sum("most").over(of_q) - F.col("most")), "asked")

    heavy = cut.withColumn("n", F.row_number().over(W.partitionBy("grp", "term", *[c for c in cut.columns if c not in ("grp", "term", "doc", "part", "long", "block")]).orderBy(F.desc("part"), "doc"))).where(F.col("n") <= champions * k).drop("n")
    first = small(asked, 96).join(heavy, ["grp", "term"]).where(fits).groupBy("q", "doc", *own).agg(F.sum("part").alias("s"), F.max("long").alias("long_match")).where(eligible)
    reached = first.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s")))).where(F.col("n") == k).select("q", (F.col("s") - SLACK).alias("least"))
    up = W.partitionBy("q").orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    need = asked.join(reached, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("leads", F.sum("most").over(up) >= F.col("least"))
    need = need.withColumn("others", F.coalesce(F.sum(F.when(~F.col("leads"), F.col("most"))).over(of_q), F.lit(0.0)))
    read = stored(need.join(sizes, ["grp", "term"]).where(F.col("top") + F.col("rest") >= F.col("least")), "read")

    met = small(read.where("leads"), 128).join(cut.repartition("doc"), ["grp", "term", "block"]).where(fits)  # dealt by document: postings move, not pairs
    found = met.groupBy("q", "grp", "doc", "least", "others", *own).agg(F.sum("part").alias("s"), F.max("long").alias("l")).where(F.col("s") + F.col("others") >= F.col("least"))
    found = stored(found, "candidates")
    # the blocks that are read are a term's heaviest ones, so their last one tells which; candidates meet their own postings, not terms and blocks
    also = read.where("NOT leads").groupBy("q", "grp", "term").agg(F.max("block").alias("last"))
    own_posts = found.select("q", "grp", "doc").hint("merge").join(cut.select("grp", "term", "block", "doc", "part", "long"), ["grp", "doc"])
    tail = own_posts.join(small(stored(also, "also"), 96), ["q", "grp", "term"]).where("block <= last").groupBy("q", "grp", "doc").agg(F.sum("part").alias("more"), F.max("long").alias("l2")).drop("grp")
    out = found.join(tail.hint("merge"), ["q", "doc"], "left").withColumn("score", F.col("s") + F.coalesce("more", F.lit(0.0))).withColumn("long_match", F.col("l") | F.coalesce("l2", F.lit(False)))
    return out.where((F.col("score") >= F.col("least")) & eligible).select("q", "doc", "score", "long_match")


def named_items(kb: DataFrame, asked: DataFrame) -> DataFrame:
    """q, doc: the items of a question's city whose names stand in it.

    The question's substrings, of the lengths that names have, meet the names as keys.
    """
    names = kb.where("name != ''").select(F.col("city_code").alias("grp"), F.col("id").alias("doc"), "name")
    lengths = names.groupBy("grp").agg(F.collect_set(F.char_length("name")).alias("sizes"))
    sized = asked.select("q", "grp", "question").join(lengths, "grp").select("q", "grp", "question", F.explode("sizes").alias("size")).where(F.col("size") <= F.char_length("question"))
    parts = sized.select("q", "grp", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("question") - F.col("size") + 1), lambda i: F.substring("question", i, F.col("size"))))).alias("name"))
    return names.join(small(stored(parts, "parts"), 64), ["grp", "name"]).select("q", "doc").distinct()


def search(kb: DataFrame, questions: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """Q, id, score, rank: the best items of a question's city.

    ``kb``: id, city_code, city_name, kind, name, text; ``questions``: q, city_code, question.  The city's name and
    stop words do not count as terms.  An asked kind restricts and boosts; without one an item must be named or
    share a term of two characters; a named item is boosted.  Only items that bounds leave among the best, those named
    and the first of an asked kind meet the question, never all of its city.  Names are distinct from empty texts.
    """
    names = kb.groupBy("city_code").agg(F.min("city_name").alias("city_name"))
    asked = questions.join(names, "city_code").withColumn("query", without_place(F.col("question"), F.col("city_name")))
    asked = asked.select("q", F.col("city_code").alias("grp"), "question", asked_kind(F.col("query")).alias("asked"), retrieval_tokens(searchable(F.col("query"))).alias("terms"))
    asked = stored(asked, "questions")
    terms = asked.select("grp", F.explode("terms").alias("term"))
    posts = weighed(kb, terms, group="city_code", doc="id", text=F.concat_ws(" ", "name", "text"), more=("kind",))
    fits = (F.col("asked") == "") | (F.col("kind") == F.col("asked"))
    found = best_scores(posts, asked.select("q", "grp", "terms", "asked"), limit, fits=fits, eligible=(F.col("asked") != "") | F.col("long_match"))
    items = kb.select(F.col("city_code").alias("grp"), F.col("id").alias("doc"), "kind", "name")
    # an asked kind lets items in that share no term: the first ones, beside as many that share some
    first = items.withColumn("n", F.row_number().over(W.partitionBy("grp", "kind").orderBy("doc"))).where(F.col("n") <= 2 * limit)
    filler = asked.where("asked != ''").join(first.withColumnRenamed("kind", "asked"), ["grp", "asked"]).select("q", "doc")
    named = stored(named_items(kb, asked), "named")
    chosen = stored(found.select("q", "doc").unionAll(filler).unionAll(named).distinct(), "chosen")
    mine = asked.select("q", "grp", F.explode(F.array_distinct("terms")).alias("term"))
    # a chosen item meets its own postings, and these the question's terms: a row for each item and term is never written or broadcast
    placed = stored(chosen.join(small(asked.select("q", "grp", "asked"), 64), "q"), "placed")
    own = posts.select("grp", "term", "doc", "part", "long").join(placed.select("q", "grp", "doc").hint("merge"), ["grp", "doc"])
    scored = own.join(small(stored(mine, "mine"), 96), ["q", "grp", "term"]).groupBy("q", "doc").agg(F.sum("part").alias("score"), F.max("long").alias("long_match"))
    pairs = placed.hint("merge").join(items, ["grp", "doc"]).join(scored.hint("merge"), ["q", "doc"], "left").join(named.withColumn("named", F.lit(True)).hint("merge"), ["q", "doc"], "left")
    is_named = F.coalesce("named", F.lit(False))
    keep = F.when(F.col("asked") != "", F.col("kind") == F.col("asked")).otherwise(is_named | F.coalesce("long_match", F.lit(False)))
    total = F.coalesce("score", F.lit(0.0)) + F.when(F.col("asked") != "", KIND_BOOST).otherwise(0.0) + F.when(is_named, NAME_BOOST).otherwise(0.0)
    kept = pairs.where(keep).withColumn("score", F.round(total, 4)).where(total > LEAST_SCORE)
    best = W.partitionBy("q").orderBy(F.desc("score"), "doc")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("q", F.col("doc").alias("id"), "score", "rank")


def answers(kb: DataFrame, questions: DataFrame, chosen: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Q, mode, grounded, reason, answer, citations (ids).

    ``chosen`` (q, ids) is what a model selected: used if it is at most three of the retrieved ids, in its order
    without repeats; else the first three retrieved count.  Live questions, unknown cities and questions without
    hits are refused.  ``found`` is what :func:`search` gives for the questions, if that is known already.
    """
    known = kb.select("city_code").distinct().withColumn("known", F.lit(True))
    live = live_question(F.col("question"))
    open_ = questions.join(known, "city_code", "left").where(F.col("known") & ~live)
    found = search(kb, open_.select("q", "city_code", "question")) if found is None else found.join(open_.select("q"), "q", "left_semi")
    hits = found.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))
    rows = questions.join(known, "city_code", "left").join(hits, "q", "left")
    rows = rows.join(chosen.select("q", "ids"), "q", "left") if chosen is not None else rows.withColumn("ids", F.lit(None).cast("array<string>"))
    allowed = F.col("ids").isNotNull() & (F.size("ids") <= CITED) & F.forall("ids", lambda i: F.coalesce(F.array_contains("hits", i), F.lit(False)))
    cited = F.when(F.col("hits").isNull(), F.array().cast("array<string>")).when(allowed, F.array_distinct("ids")).otherwise(F.slice("hits", 1, CITED))
    reason = F.when(F.col("known").isNull(), "unknown_city").when(live, "live").when(F.col("hits").isNull(), "no_hit").when(allowed & (F.size("ids") == 0), "not_enough")
    rows = rows.select("q", "city_code", reason.alias("reason"), cited.alias("citations"), F.coalesce(allowed, F.lit(False)).alias("rag"))
    items = rows.select("q", F.posexplode("citations").alias("n", "id")).join(kb.select("id", "name", "text"), "id")
    line = F.concat("name", F.lit("："), "text", F.lit(" ["), (F.col("n") + 1).cast("string"), F.lit("]"))
    texts = items.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("answer"))
    grounded = F.size("citations") > 0
    mode = F.when(~grounded, "insufficient").when(F.col("rag"), "rag").otherwise("retrieval")
    return rows.join(texts, "q", "left").select("q", mode.alias("mode"), grounded.alias("grounded"), "reason", F.coalesce("answer", "reason").alias("answer"), "citations")


def guides(kb: DataFrame) -> DataFrame:
    """Per city: up to three foods and sights in file order, sources by URL (last title, first place), newest date."""
    first = lambda kind: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "name")))), lambda x: x["name"]), 1, 3)
    own = kb.groupBy("city_code").agg(F.min("city_name").alias("city_name"), first("food").alias("foods"), first("sight").alias("sights"), F.max("verified_on").alias("updated_on"))
    pages = kb.groupBy("city_code", "source_url").agg(F.min("pos").alias("p"), F.max_by("source_title", "pos").alias("title"))
    sources = pages.groupBy("city_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "source_url", "title"))), lambda x: F.struct(x["title"].alias("title"), x["source_url"].alias("url"))).alias("sources"))
    return own.join(sources, "city_code")


def inventory(kb: DataFrame) -> DataFrame:
    """city_code, kind, n."""
    return kb.groupBy("city_code", "kind").agg(F.count("*").alias("n"))
