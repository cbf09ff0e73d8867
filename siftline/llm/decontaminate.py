"""Benchmark decontamination with a distributed positional inverted index (DataFrame operations only).

The index is a table of postings (term, document, position).  A posting whose term is in no test item can
never take part in a match, so the postings are joined with the test vocabulary before they are written; the
table is clustered by term inside each file, so a term's list is one run and row groups carry term bounds.

A phrase query takes the rarest terms of each window by their list lengths, adjusts each list by the term's
offset and intersects: what survives are diagonals (document, item, shift) on which every rare term of some
window stands in place.  Only for these the lists of the other terms are read, and runs of matched item
positions of at least the window's length give exact occurrences.  Frequent terms' lists thus never meet the
test items; the rows that move are as many as the rare terms' postings.

Rows are told apart by (document id, hash of the text), so that rows which share an id are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import lower_ascii, small, stash, unstash

#: Words: digits, lower-case letters and every character from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of each document, with a number below ``ENDS`` so that no one key has all documents;
#: its position is the document's length.  No word is like it.
END, ENDS = "\x00", 1024
END_TERM = -1
#: So many rarest terms of a window are intersected before the rest is looked up.
RAREST = 3


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


@dataclass
class Index:
    """``postings``: term, d (document id), h (text hash), pos; ``terms``: word, term, cf (list length);
    ``items``: item, item_id, j, term, n for every word of every test item."""

    postings: DataFrame
    terms: DataFrame
    items: DataFrame


def build_index(docs: DataFrame, tests: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Index:
    """Stores the postings of ``docs`` that terms of ``tests`` can reach, and the test terms with their list lengths.

    Null or empty texts give a document of length 0 and an item that matches nothing.  Repeated rows are kept.
    Columns other than those named are ignored, whatever they are called.
    """
    asked = stash(tests.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("ws")), "items")
    flat = asked.select("item", "item_id", F.size("ws").alias("n"), F.posexplode("ws").alias("j", "word"))
    vocab = stash(flat.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocab")
    ends = docs.sparkSession.range(ENDS).select(F.concat(F.lit(END), F.col("id").cast("string")).alias("word"), F.lit(END_TERM).cast("long").alias("term"))
    end = F.concat(F.lit(END), F.pmod(F.col("h").bitwiseXOR(F.xxhash64("d")), F.lit(ENDS)).cast("string"))
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    seen = rows.select("d", "h", F.posexplode(F.concat(words(F.col("t")), F.array(end))).alias("pos", "word"))
    postings = stash(
        seen.join(small(vocab.unionAll(ends), 64), "word").select("term", "d", "h", "pos").sortWithinPartitions("term"),
        "postings",
    )
    lengths = postings.groupBy("term").agg(F.count("*").alias("cf"))
    terms = stash(vocab.join(lengths, "term", "left").select("word", "term", F.coalesce("cf", F.lit(0)).alias("cf")), "terms")
    items = stash(flat.join(small(vocab, 64), "word").select("item", "item_id", "j", "term", "n"), "item-terms")
    unstash(docs.sparkSession, asked, vocab)
    return Index(postings, terms, items)


def rare_sets(index: Index, window: int, rarest: int = RAREST) -> DataFrame:
    """The distinct sets of rarest positions over all windows: one row (item, set, j, term, bit, full) per member."""
    at = index.items.join(index.terms.select("term", "cf"), "term")
    lo, hi = F.greatest(F.lit(0), F.col("j") - window + 1), F.least(F.col("j"), F.greatest(F.lit(0), F.col("n") - window))
    spread = at.select("item", "j", "term", "cf", F.explode(F.sequence(lo, hi)).alias("start"))
    ranked = spread.withColumn("r", F.row_number().over(W.partitionBy("item", "start").orderBy("cf", "j"))).where(F.col("r") <= rarest)
    sets = ranked.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("j", "term"))).alias("set")).select("item", "set").distinct()
    return sets.select("item", "set", F.expr("shiftleft(1, size(set)) - 1").alias("full"), F.posexplode("set").alias("r", "m")).select(
        "item", F.transform("set", lambda m: m["j"]).alias("set"), F.col("m.j").alias("j"), F.col("m.term").alias("term"), F.expr("shiftleft(1, r)").alias("bit"), "full"
    )


def phrase_matches(index: Index, window: int = 13) -> DataFrame:
    """Exact occurrences: d, h, item, item_id, s, e (first and last position in the document).

    A window is ``window`` consecutive item words, or the whole item if it is shorter; overlapping windows on
    one diagonal come as one longer run.
    """
    seeds = stash(rare_sets(index, window), "seeds")
    hits = index.postings.join(small(seeds, 96), "term").select("d", "h", "item", "set", (F.col("pos") - F.col("j")).alias("shift"), "bit", "full")
    whole = hits.groupBy("d", "h", "item", "set", "shift").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full")).where("bits = full")
    diagonals = stash(whole.select("d", "h", "item", "shift").distinct(), "diagonals")
    wanted = stash(
        diagonals.join(small(index.items, 64), "item").select("d", "h", "item", "item_id", "n", "shift", "j", (F.col("shift") + F.col("j")).alias("pos"), "term"),
        "wanted",
    )
    p, w = index.postings.alias("p"), small(wanted, 96).alias("w")
    same = (F.col("p.term") == F.col("w.term")) & F.col("p.d").eqNullSafe(F.col("w.d")) & (F.col("p.h") == F.col("w.h")) & (F.col("p.pos") == F.col("w.pos"))
    found = p.join(w, same).select("w.d", "w.h", "w.item", "w.item_id", "w.n", "w.shift", "w.j").distinct()
    line = W.partitionBy("d", "h", "item", "shift").orderBy("j")
    runs = found.withColumn("run", F.col("j") - F.row_number().over(line)).groupBy("d", "h", "item", "item_id", "n", "shift", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    return runs.where(F.col("b") - F.col("a") + 1 >= F.least(F.col("n"), F.lit(window))).select(
        "d", "h", "item", "item_id", (F.col("shift") + F.col("a")).alias("s"), (F.col("shift") + F.col("b")).alias("e")
    )


def proximity_matches(index: Index, slop: int, window: int = 13) -> DataFrame:
    """Near occurrences: d, h, item, item_id, start (of the window in the item), pos.

    ``pos`` is a place of the window's rarest term round which every distinct term of the window stands, in any
    order, at most ``window - 1 + slop`` words away.  Each exact occurrence is one of these too.  Lists are met
    from the rarest on: only documents that hold all of a window's ``RAREST`` rarest terms within reach of the
    rarest are joined with the rest.
    """
    at = index.items.join(index.terms.select("term", "cf"), "term")
    lo, hi = F.greatest(F.lit(0), F.col("j") - window + 1), F.least(F.col("j"), F.greatest(F.lit(0), F.col("n") - window))
    spread = at.select("item", "item_id", "term", "cf", F.explode(F.sequence(lo, hi)).alias("start")).distinct()
    by = W.partitionBy("item", "start")
    ranked = stash(spread.withColumn("r", F.row_number().over(by.orderBy("cf", "term"))).withColumn("m", F.count("*").over(by)), "ranked")
    reach = window - 1 + slop
    keys = ["d", "h", "item", "item_id", "start", "m", "pos"]
    anchors = index.postings.join(small(ranked.where("r = 1"), 64), "term").select(*keys).distinct()
    for low, high in ((2, RAREST), (RAREST + 1, window)):
        members = ranked.where(F.col("r").between(low, high)).select("item", "start", "term")
        listed = index.postings.select(F.col("d").alias("d2"), F.col("h").alias("h2"), "term", F.col("pos").alias("pos2")).distinct()
        need = F.least(F.col("m"), F.lit(high)) - low + 1
        near = F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("term") == F.col("term2")) & (F.abs(F.col("pos") - F.col("pos2")) <= reach)
        asked = anchors.where(need > 0).join(small(members, 64), ["item", "start"])
        met = asked.join(listed.withColumnRenamed("term", "term2"), near).groupBy(*keys).agg(F.countDistinct("term").alias("got"))
        anchors = met.where(F.col("got") == need).select(*keys).unionAll(anchors.where(need <= 0))
    return anchors.drop("m")


def decontaminate(docs: DataFrame, tests: DataFrame, *, window: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hash (of the text).

    ``n_hit`` counts the words inside any occurrence of any window, ``contaminated`` is ``n_hit > 0`` and
    ``share * n_hit >= n_words``.  An item without an id marks words but is not listed.  With no documents the
    result is empty; with no items nothing is hit.
    """
    index = build_index(docs, tests, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text)
    runs = phrase_matches(index, window)
    before = W.partitionBy("d", "h").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.col("e") - F.greatest(F.col("s") - 1, F.coalesce(F.max("e").over(before), F.lit(-1)))
    hits = runs.withColumn("new", F.greatest(F.lit(0), fresh)).groupBy("d", "h").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ends = index.postings.where(F.col("term") == END_TERM).select("d", "h", F.col("pos").cast("long").alias("n_words")).alias("a")
    b = hits.alias("b")
    n_hit, ids = F.coalesce(F.col("b.n_hit"), F.lit(0)).cast("long"), F.coalesce(F.col("b.ids"), F.array().cast("array<string>"))
    return ends.join(b, F.col("a.d").eqNullSafe(F.col("b.d")) & (F.col("a.h") == F.col("b.h")), "left").select(
        F.col("a.d").alias("doc_id"),
        F.col("a.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("a.n_words"))).alias("contaminated"),
        F.col("a.h").alias("hash"),
    )
