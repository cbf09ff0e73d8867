"""Mixing sources to target weights (DataFrame operations only).

Each source's documents, in a fixed order, form one stream of tokens that is packed into blocks of a fixed
length; a source's last block may be shorter.  A mix is a number of slots, dealt to output shards of a fixed
number of slots.  Every slot draws its source from the target weights with a hash of its own, so the counts of
a shard are a multinomial draw; the few slots that a source drew beyond its quota are handed to sources that
drew too few, so that totals meet the targets.  The k-th slot of a source maps to the block
``permutation(source, k div blocks)(k mod blocks)``: every epoch runs over all blocks once, in a pseudorandom
order of its own, and a block is joined by its index.  A source's last slot takes just the first tokens of its block
that its target still lacks, so that sources of any size, also of less than a block, meet their targets.

Running sums never put a source into one task: they are taken over small groups, then over groups' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import TOKEN, small, stash

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST = 3
#: Rounds of the swap-or-not shuffle that permutes a source's blocks.
ROUNDS = 32
#: Rows of a group inside which a running sum is taken.
GROUP = 2_000
#: Equal steps of the inverse distribution function by which slots meet sources.
STEPS = 4096


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of index ``x`` in a pseudorandom permutation of ``0 .. n-1`` that ``key`` names.

    A swap-or-not shuffle: each round pairs ``x`` with ``(r - x) mod n`` and a bit hashed from the larger of the
    two says whether they swap, which is one-to-one for every ``n``.
    """

    def step(acc: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pivot"), *key, i), n) - acc, n)
        swap = F.xxhash64(F.lit("swap"), *key, i, F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """Adds rank, weight and target to ``sizes`` (source, source_size): ``share`` of all sizes by weight.

    A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is
    above.  Sources are ranked by code point, null last.  One row per source; the running sums are over sources.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (share * F.sum("source_size").over(W.partitionBy()) - (F.sum("cap").over(by) - F.col("cap"))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    open_level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank"))).over(W.partitionBy())
    return ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap")))).drop("cap", "level", "full")


def running(df: DataFrame, keys: list[str], group: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows before, by (``group``, ``order``) within ``keys``.

    A first window stays inside (keys, group); a second one runs over the groups' totals.
    """
    inner = W.partitionBy(*keys, group).orderBy(*order)
    totals = df.groupBy(*keys, group).agg(F.sum(amount).alias("_sum"))
    outer = W.partitionBy(*keys).orderBy(group)
    base = totals.withColumn("_base", F.sum("_sum").over(outer) - F.col("_sum")).drop("_sum")
    run = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("_in", F.sum(amount).over(run) - F.col(amount)).join(base, [*keys, group]).withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_base")


class Mix:
    """The mix of one set of documents.

    ``sources``: source, source_size, rank, weight, target, blocks, quota.  ``documents``: d, h (hash of the
    text), size, rank, at (first token in its source's stream).  ``slots``: shard, slot, rank, k (number of the
    slot in its source), epoch, block, take (tokens that the slot takes from the front of its block).
    """

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 128, shard_slots: int = 65_536, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0):
        self.block = block
        size = F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
        sized = stash(docs.select(F.col(doc_id).alias("d"), F.col(source).alias("source"), F.xxhash64(text).alias("h"), size.alias("size")), "sizes")
        ranked = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most, share)
        some, size = F.col("source_size") > 0, F.col("source_size").cast("long")
        want = F.least(F.round("target").cast("long"), most * size)
        # a block that is short may come before the last slot: one more slot than full blocks would need
        quota = F.expr("words div source_size * blocks + if(words % source_size > 0, least(blocks, ceil(words % source_size / block) + 1), 0)")
        planned = ranked.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("block", F.lit(block)).withColumn("words", want)
        self.sources = stash(planned.withColumn("quota", F.when(some, quota).otherwise(0).cast("long")).drop("block"), "sources")
        known = small(self.sources.select("source", "rank", "rows"), 64)
        joined = sized.alias("s").join(known.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source"))).select("d", "h", "size", "rank", "rows")
        dealt = joined.withColumn("_group", F.pmod(F.xxhash64("d", "h"), F.ceil(F.col("rows") / GROUP))).drop("rows")
        self.documents = stash(running(dealt, ["rank"], "_group", ["d", "h"], "size", "at").drop("_group"), "placed")
        self.slots = stash(self._taking(stash(self._slots(shard_slots, seed), "dealt")), "slots")

    def _slots(self, shard_slots: int, seed: int) -> DataFrame:
        spark, total = self.sources.sparkSession, self.sources.agg(F.sum("quota")).first()[0] or 0
        order = W.orderBy("rank")
        upto = self.sources.where("quota > 0").select("rank", "blocks", "quota", F.sum("quota").over(order).alias("hi")).withColumn("lo", F.col("hi") - F.col("quota"))
        width = -(-max(total, 1) // STEPS)
        steps = upto.withColumn("step", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
        slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u"))
        drawn = slots.withColumn("step", F.floor(F.col("u") / width)).join(small(stash(steps, "steps"), 64), "step").where("u >= lo and u < hi").select("shard", "slot", "rank", "blocks", "quota", F.lit(1).alias("one"))
        numbered = stash(running(drawn, ["rank"], "shard", ["slot"], "one", "k"), "drawn")
        kept = numbered.where("k < quota").select("shard", "slot", "rank", "blocks", "k")
        # slots beyond a source's quota go to those that drew too few, in order of slot
        got = numbered.groupBy("rank").agg(F.count("*").alias("got"))
        short = upto.join(got, "rank", "left").select("rank", "blocks", F.coalesce("got", F.lit(0)).alias("got"), "quota").where("got < quota")
        short = short.withColumn("to", F.sum(F.col("quota") - F.col("got")).over(order)).withColumn("from", F.col("to") - (F.col("quota") - F.col("got")))
        freed = running(numbered.where("k >= quota").select("shard", "slot", "one").withColumn("all", F.lit(0)), ["all"], "shard", ["slot"], "one", "i").select("shard", "slot", "i")
        moved = freed.join(F.broadcast(short) if total < 1 else small(stash(short, "short"), 64), (F.col("i") >= F.col("from")) & (F.col("i") < F.col("to")))
        moved = moved.select("shard", "slot", "rank", "blocks", (F.col("got") + F.col("i") - F.col("from")).alias("k"))
        every = kept.unionByName(moved).withColumn("epoch", F.floor(F.col("k") / F.col("blocks")))
        place = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch"))
        return every.select("shard", "slot", "rank", "k", "epoch", place.alias("block"))

    def _taking(self, slots: DataFrame) -> DataFrame:
        """Adds ``take`` to ``slots``, and whether it is less than the block.

        Before place ``p`` of the last epoch lie ``p`` blocks, less what the source's short block lacks if its place
        comes before.
        """
        size = self.sources.where("words > 0").select("rank", "source_size", "blocks", "words", F.expr("words div source_size").alias("full"))
        sized = slots.join(small(size, 64), "rank").withColumn("length", F.least(F.lit(self.block), F.col("source_size") - F.col("block") * self.block)).withColumn("place", F.col("k") % F.col("blocks"))
        short = sized.where("epoch = full and block = blocks - 1").select("rank", F.col("place").alias("short"), (self.block - F.col("length")).alias("lack"))
        placed = sized.join(small(stash(short, "short-blocks"), 32), "rank", "left")
        before = F.col("place") * self.block - F.when(F.col("short") < F.col("place"), F.col("lack")).otherwise(0)
        left = F.col("words") - F.col("full") * F.col("source_size") - before
        take = F.when(F.col("epoch") < F.col("full"), F.col("length")).otherwise(F.greatest(F.lit(0), F.least("length", left)))
        return placed.withColumn("take", take.cast("long")).select("shard", "slot", "rank", "k", "epoch", "block", "take", (F.col("take") < F.col("length")).alias("part"))

    def pieces(self) -> DataFrame:
        """d, h, size, rank, at, block and the part of the document in it: first (token of the document), n, from (place in the block)."""
        spread = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / self.block), F.floor((F.col("at") + F.col("size") - 1) / self.block))))
        first = F.greatest(F.col("block") * self.block, F.col("at"))
        last = F.least((F.col("block") + 1) * self.block, F.col("at") + F.col("size"))
        return spread.select("d", "h", "size", "rank", "at", "block", (first - F.col("at")).alias("first"), (last - first).alias("n"), (first - F.col("block") * self.block).alias("from"))

    def taken(self) -> DataFrame:
        """One row per document: d, size, rank, taken (tokens that the mix takes, repeats counted)."""
        times = self.slots.groupBy("rank", "block").agg(F.count_if(~F.col("part")).alias("times"), F.max(F.when(F.col("part"), F.col("take"))).alias("take"))
        taken = F.col("n") * F.coalesce("times", F.lit(0)) + F.greatest(F.lit(0), F.least("n", F.coalesce("take", F.lit(0)) - F.col("from")))
        sums = self.pieces().join(times, ["rank", "block"], "left").groupBy("d", "size", "rank", "at").agg(F.sum(taken).alias("taken"))
        return sums.select("d", "size", "rank", "taken").unionAll(self.documents.where("size = 0").select("d", "size", "rank", F.lit(0).cast("long")))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source_rank.

    ``size`` is the number of runs of other than ASCII blanks (null or empty text: 0); a null source is a source
    of its own, ranked last.  Repeated rows count each.  No documents give no rows.
    """
    mix = Mix(docs, **options)
    s = small(mix.sources.select("rank", "source_size", "target"), 64)
    return mix.taken().join(s, "rank").select(F.col("d").alias("doc_id"), "size", "source_size", "target", "taken", F.col("rank").alias("source_rank"))


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs`` that a corpus table has: doc_id, text, lang, source, n_chars.

    One row per document and epoch that takes tokens of it: the whole text if all its tokens are taken in that
    epoch, else the taken tokens in order, joined by blanks.  Texts are split once, whatever their length.  A row keeps
    its own source; of rows that repeat id, text and source the smallest lang is taken.  Null or blank texts are in
    no row.  Other columns are ignored, whatever they are called.  No documents give no rows.
    """
    mix = Mix(docs, **options)
    cut = mix.pieces().join(mix.slots.select("rank", "block", "epoch", "take"), ["rank", "block"])
    cut = cut.withColumn("n", F.least("n", F.col("take") - F.col("from"))).where("n > 0")
    spans = cut.groupBy("d", "h", "size", "rank", "at", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"), F.sum("n").alias("n"))
    known = small(mix.sources.select("source", "rank"), 64).alias("r")
    ranked = docs.select("doc_id", "text", "lang", "source").alias("s").join(known, F.col("s.source").eqNullSafe(F.col("r.source"))).select("s.*", "r.rank")
    same = ranked.groupBy("doc_id", F.xxhash64("text").alias("h"), "rank").agg(*(F.min(c).alias(c) for c in ("text", "lang", "source")))
    both = spans.join(same, F.col("d").eqNullSafe(F.col("doc_id")) & (spans.h == same.h) & (spans["rank"] == same["rank"]))
    # the outer function holds the words once for all spans
    held = F.array(F.struct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("words"), "spans"))
    taken = F.transform(held, lambda x: F.flatten(F.transform(x["spans"], lambda s: F.slice(x["words"], (s["first"] + 1).cast("int"), s["n"].cast("int")))))
    text = F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(F.array_join(taken[0], " "))
    return both.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))
