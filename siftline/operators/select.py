"""Subset selection: quotas by largest remainder, coverage, three-stage allocation, strata.

The greedy loops of coverage and allocation are equal to orders of windowed ranks, so each is a few windows over
cells or bands and one ordered limit.  Ranks in cells, bands and strata come from range partitions
(:func:`ranking.group_rank`), so a group may be of any size; other windows run over cells, bands or quotas only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.functions.text import seeded_order
from siftline.operators.ranking import group_rank
from siftline.scratch import dropped, stored

#: Target shares of difficulty bands, share of the budget for coverage, most that a cell may take.
TARGET_MIX = {"easy": 0.30, "medium": 0.50, "hard": 0.20}
FLOOR_SHARE, CELL_SHARE, POOL, NOTED = 0.25, 0.40, 1.35, 0.06


def largest_remainder(weights: DataFrame, total: int | Column, *, weight: str = "weight", tie: list[Column], within: list[str] = ()) -> DataFrame:
    """Adds ``quota``: whole numbers by weight that add up to ``total`` (per ``within``).

    Leftovers go to the largest fractions; ``tie`` orders equal ones.  Without positive weight all quotas are 0.
    The windows are over quota rows, not over data.
    """
    whole = W.partitionBy(*within)
    sum_ = F.sum(weight).over(whole)
    share = F.when(sum_ > 0, (F.lit(total) if isinstance(total, int) else total) * F.col(weight) / sum_).otherwise(0.0)
    # a product like 0.3 * 10 may fall a hair below a whole number
    base = weights.withColumn("_x", F.round(share, 9)).withColumn("_f", F.floor("_x"))
    left = F.round(F.sum("_x").over(whole)) - F.sum("_f").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc(F.col("_x") - F.col("_f")), *tie))
    return base.withColumn("_left", left).withColumn("_p", place).withColumn("quota", (F.col("_f") + F.when(F.col("_p") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_left", "_p")


def coverage_gains(df: DataFrame, *, cell: str = "cell", quality: str = "quality", idx: str = "idx", start: DataFrame | None = None) -> DataFrame:
    """Adds ``gain``: what each row adds to the sum of square roots, taken best first inside its cell.

    Negative qualities count as 0.  ``start`` (cell, sum) holds what must-have rows have put into cells already.
    """
    rows = df.withColumn("_q", F.greatest(F.lit(0.0), F.coalesce(F.col(quality).cast("double"), F.lit(0.0))))
    if start is not None:
        rows = rows.join(start.select(F.col("cell").alias(cell), F.col("sum").alias("_s0")), cell, "left")
    else:
        rows = rows.withColumn("_s0", F.lit(0.0))
    best = W.partitionBy(cell).orderBy(F.desc("_q"), idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.coalesce(F.col("_s0"), F.lit(0.0)) + F.sum("_q").over(best)
    return rows.withColumn("gain", F.sqrt(upto) - F.sqrt(F.greatest(F.lit(0.0), upto - F.col("_q")))).drop("_q", "_s0")


def greedy_cover(df: DataFrame, budget: int, *, cell: str = "cell", quality: str = "quality", idx: str = "idx", must: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The rows that maximise the sum over cells of the square root of the summed quality, with ``gain`` and ``pick``.

    ``must`` (idx) come first, in order of idx; ``excluded`` (idx) never.  Stops when nothing gains.  Ties go to
    the smaller idx.
    """
    pool = df if excluded is None else df.join(excluded.select(idx).distinct(), idx, "left_anti")
    if must is None:
        gains = coverage_gains(pool, cell=cell, quality=quality, idx=idx)
        picked = gains.where("gain > 0").orderBy(F.desc("gain"), idx).limit(budget).withColumn("_m", F.lit(1))
    else:
        held = pool.join(must.select(idx).distinct(), idx, "left_semi")
        by = W.partitionBy(cell).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
        q = F.greatest(F.lit(0.0), F.coalesce(F.col(quality).cast("double"), F.lit(0.0)))
        upto = F.sum(q).over(by)
        first = held.withColumn("gain", F.sqrt(upto) - F.sqrt(F.greatest(F.lit(0.0), upto - q))).orderBy(idx).limit(budget).withColumn("_m", F.lit(0))
        sums = first.groupBy(F.col(cell).alias("cell")).agg(F.sum(q).alias("sum"))
        rest = coverage_gains(pool.join(first.select(idx), idx, "left_anti"), cell=cell, quality=quality, idx=idx, start=sums)
        picked = first.unionByName(rest.where("gain > 0").withColumn("_m", F.lit(1))).orderBy("_m", F.when(F.col("_m") == 0, F.lit(0.0)).otherwise(-F.col("gain")), idx).limit(budget)
    order = W.orderBy("_m", F.when(F.col("_m") == 0, F.lit(0.0)).otherwise(-F.col("gain")), idx)  # over the picks only
    return picked.withColumn("pick", F.row_number().over(order)).drop("_m")


def coverage_objective(df: DataFrame, *, cell: str = "cell", quality: str = "quality") -> DataFrame:
    """One row: cells, rows, objective."""
    q = F.greatest(F.lit(0.0), F.coalesce(F.col(quality).cast("double"), F.lit(0.0)))
    per = df.groupBy(cell).agg(F.count("*").alias("n"), F.sum(q).alias("s"))
    return per.agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.sqrt("s")), F.lit(0.0)).alias("objective"))


def coverage_report(every: DataFrame, picked: DataFrame, *, cell: str = "cell") -> DataFrame:
    """One row: universe (cells of all rows, excluded ones too), covered, ratio, empty (sorted cells not covered)."""
    cells = every.select(cell).distinct().join(picked.select(cell).distinct().withColumn("_in", F.lit(1)), cell, "left")
    out = cells.agg(F.count("*").alias("universe"), F.count("_in").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.col(cell)))).alias("empty"))
    return out.select("universe", "covered", F.when(F.col("universe") > 0, F.col("covered") / F.col("universe")).otherwise(0.0).alias("ratio"), "empty")


def gain_range(picked: DataFrame) -> DataFrame:
    """One row: the marginal gains of the first and of the last pick of :func:`greedy_cover`."""
    return picked.agg(F.min_by("gain", "pick").alias("first"), F.max_by("gain", "pick").alias("last"))


def by_id_or_first(df: DataFrame, key: str, asked, *order: Column) -> DataFrame:
    """The row whose key is ``asked``, or the first one in the order if there is none."""
    return df.orderBy(F.when(F.col(key) == F.lit(asked), 0).otherwise(1), *order).limit(1)


def random_baseline(df: DataFrame, budget: int, *, trials: int = 200, seed: int = 20260921, cell: str = "cell", quality: str = "quality", idx: str = "idx") -> DataFrame:
    """One row: the mean objective over random draws of ``budget`` rows, each draw the rows of smallest hash."""
    q = F.greatest(F.lit(0.0), F.coalesce(F.col(quality).cast("double"), F.lit(0.0)))
    slim = df.select(F.col(cell).alias("cell"), q.alias("q"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), F.col(idx).alias("idx"))
    hashed = slim.withColumn("h", seeded_order(seed, F.col("trial"), F.col("idx")))
    drawn = smallest_hashes(hashed, trials, budget, df.count())
    ranked = drawn.withColumn("_r", F.row_number().over(W.partitionBy("trial").orderBy("h", "idx")))
    per = ranked.where(F.col("_r") <= budget).groupBy("trial", "cell").agg(F.sum("q").alias("s"))
    return per.groupBy("trial").agg(F.sum(F.sqrt("s")).alias("f")).agg(F.avg("f").alias("objective"))


def smallest_hashes(hashed: DataFrame, trials: int, budget: int, n: int, wide: float = 1.5) -> DataFrame:
    """Rows (trial, h, …) of which each trial's ``budget`` smallest hashes are surely some; ``n`` rows have a hash in each trial.

    Hashes are even, so those below a share of their range hold about as many rows; the share starts at ``wide`` times
    the budget and some deviations and doubles until every trial has enough.
    """
    share = (wide * budget + 6 * budget**0.5) / max(n, 1)
    while share < 1:
        under = stored(hashed.where(F.substring("h", 1, 15) < F.lit(f"{int(share * 16**15):015x}")), "drawn")
        few = under.groupBy("trial").agg(F.count("*").alias("n")).where(F.col("n") >= min(budget, n)).count()
        if few == trials:
            return under
        dropped(hashed.sparkSession, under)
        share *= 2
    return hashed


def allocate(df: DataFrame, budget: int, *, target_mix: dict[str, float] = TARGET_MIX, floor_share: float = FLOOR_SHARE, cell_share: float = CELL_SHARE, cell: str = "cell", band: str = "band", quality: str = "quality", idx: str = "idx") -> DataFrame:
    """Picks in three stages, with ``stage`` (floor, mix, quality) and ``pick``.

    Floor: the best rows of every cell, up to a floor.  Mix: the band that lacks most of its target next, best rows
    first.  Quality: the best rows left.  No cell gives more than its cap.  Every cell must lie in one band, which
    is checked; ties go to the smaller idx.
    """
    q = F.coalesce(F.col(quality).cast("double"), F.lit(0.0))
    torn = df.groupBy(cell).agg(F.count_distinct(band).alias("n")).where("n > 1")
    if not torn.isEmpty():
        raise ValueError("a cell lies in more than one band")
    cells = df.select(cell).distinct().count()
    cap = max(1, int(budget * cell_share))
    floor = max(1, int(budget * floor_share) // cells) if cells and int(budget * floor_share) > 0 else 0
    spark = df.sparkSession
    quota = largest_remainder(spark.createDataFrame([(b, w, i) for i, (b, w) in enumerate(target_mix.items())], "b string, weight double, i int"), budget, tie=[F.col("i")]).select(F.col("b").alias(band), F.col("quota").alias("_target"))
    leads = df.groupBy(F.col(cell).alias("_of")).agg(F.min(idx).alias("_lead"))
    capped_ = group_rank(df, [cell], F.desc(q), F.col(idx), name="_c").where(F.col("_c") <= cap)
    rows = stored(capped_.join(small(leads, 64), F.col(cell).eqNullSafe(F.col("_of"))).drop("_of"), "capped")
    one = rows.where(F.col("_c") <= min(floor, cap)).orderBy("_lead", "_c").limit(budget)
    one = one.withColumn("stage", F.lit("floor")).withColumn("_o1", F.col("_lead").cast("double")).withColumn("_o2", F.col("_c").cast("double"))
    left = budget - one.count()
    rest = rows.join(one.select(idx), idx, "left_anti")
    have = one.groupBy(band).agg(F.count("*").alias("_have"))
    lacks = group_rank(rest, [band], F.desc(q), F.col(idx), name="_k").join(F.broadcast(quota), band).join(F.broadcast(have), band, "left")  # a row for each band
    lacks = lacks.withColumn("_level", F.col("_target") - F.coalesce("_have", F.lit(0)) - F.col("_k") + 1).where("_level > 0")
    first_of_band = df.groupBy(band).agg(F.min(idx).alias("_band"))
    two = lacks.join(F.broadcast(first_of_band), band).orderBy(F.desc("_level"), "_band", "_k").limit(left)
    two = two.withColumn("stage", F.lit("mix")).withColumn("_o1", -F.col("_level").cast("double")).withColumn("_o2", F.col("_band").cast("double"))
    left -= two.count()
    taken = one.select(idx).unionAll(two.select(idx))
    three = rows.join(taken, idx, "left_anti").orderBy(F.desc(q), idx).limit(left).withColumn("stage", F.lit("quality")).withColumn("_o1", -q).withColumn("_o2", F.col(idx).cast("double"))
    columns = [*df.columns, "stage", "_o1", "_o2"]
    picks = one.select(*columns).unionAll(two.select(*columns)).unionAll(three.select(*columns))
    stage = F.when(F.col("stage") == "floor", 0).when(F.col("stage") == "mix", 1).otherwise(2)
    return picks.withColumn("pick", F.row_number().over(W.orderBy(stage, "_o1", "_o2", idx))).drop("_o1", "_o2")  # over the picks only


def mix_report(picked: DataFrame, *, band: str = "band", target_mix: dict[str, float] = TARGET_MIX) -> DataFrame:
    """A2: band, n, share, target, noted (off by more than 0.06)."""
    spark = picked.sparkSession
    want = spark.createDataFrame(list(target_mix.items()), f"{band} string, target double")
    counts = picked.groupBy(band).agg(F.count("*").alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy())  # a row per band
    out = want.join(counts, band, "left").withColumn("share", F.when(total > 0, F.round(F.coalesce("n", F.lit(0)) / total, 4)).otherwise(0.0))
    return out.select(band, F.coalesce("n", F.lit(0)).alias("n"), "share", "target", (F.abs(F.col("share") - F.col("target")) > NOTED).alias("noted"))


def stratified(df: DataFrame, total: int, keys: list[str], *, seed: int = 42, idx: str = "idx", tie: list[Column] | None = None, refill: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """``total`` rows over strata by largest remainder, inside a stratum in seeded random order.

    ``weights`` (keys, weight) are the strata's shares, their sizes if not given.  With ``refill`` what strata
    cannot give is taken from the leftovers in turn, strata in order.  Adds ``rank`` (in the stratum).
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    shares = sizes.withColumn("weight", F.col("_size").cast("double")) if weights is None else weights
    quotas = largest_remainder(shares, total, tie=tie or [F.col(k) for k in keys]).select(*keys, "quota")
    placed = group_rank(df, keys, seeded_order(seed, F.col(idx)), F.col(idx), name="rank")
    ranked = placed.join(small(stored(quotas, "quotas"), 64), keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    drawn = ranked.where("rank <= quota").drop("quota")
    if not refill:
        return drawn
    short = total - drawn.count()
    spare = ranked.where("rank > quota").orderBy(F.col("rank") - F.col("quota"), *keys).limit(max(0, short)).drop("quota")
    return drawn.unionByName(spare)


def capped(df: DataFrame, *, group: str, cap: str, seed: int = 20260921, idx: str = "idx") -> DataFrame:
    """At most ``cap`` (a column, null for no limit) rows of each group, in seeded random order."""
    ranked = group_rank(df, [group], seeded_order(seed, F.col(idx)), F.col(idx), name="_r")
    return ranked.where(F.col(cap).isNull() | (F.col("_r") <= F.col(cap))).drop("_r")


def top_up(picked: DataFrame, spare: DataFrame, size: int, *, idx: str = "idx") -> DataFrame:
    """T5: ``picked`` and, if it is too short, the first of ``spare`` by idx."""
    missing = max(0, size - picked.count())
    return picked.unionByName(spare.orderBy(idx).limit(missing), allowMissingColumns=True)


def one_per(df: DataFrame, key: str, n: int, *, times: int = 3, idx: str = "idx") -> DataFrame:
    """The first row of each key, repeated, cut to ``n`` rows."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(idx))).where("_r = 1").drop("_r")
    return first.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(times)))).orderBy("round", idx).limit(n)
