"""A Merkle manifest of a dataset, in higher-order SQL functions.

Each row is a leaf: the digest of its fields, length-prefixed.  The leaves of a group, in order, are cut into arrays of
``BLOCK``; ``aggregate`` over a ``sequence`` of levels collapses an array by ``transform`` and ``slice``, two neighbours at a
time, an odd one alone.  The roots of a group's arrays are the leaves of the next layer, and so on until one is left, the
group's subroot; the subroots, in the order of their groups, give the root the same way.  An array has a power of two
of leaves, so collapsing array by array gives what collapsing the whole level would.

A row's proof is its siblings on the way to the root, first those in its array, then those of its array's root, and so
on.  With them :func:`folded` leads from a leaf to the root, without any other row.

Places come from range partitions, so a group of any size is spread over many tasks; no task holds more than its
share of rows, one array at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import shared_root, small, stash, unstash
from siftline.operators.ranking import global_rank

#: Levels that an array collapses, and its leaves.
LEVELS = 8
BLOCK = 1 << LEVELS


def digest(*parts: Column) -> Column:
    """H: the lower-case hexadecimal SHA-256 of strings in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def collapsed(nodes: str, n: str) -> Column:
    """All levels over an array of nodes (SQL text), as an array of arrays; ``n`` is how many nodes the whole layer has.

    Where the layer has more than one array, each goes up ``LEVELS`` levels, a node that is alone too.
    """
    depth = f"IF({n} > {BLOCK}, {LEVELS}, IF({n} > 1, length(bin({n} - 1)), 0))"
    pair = "sha2(CAST(concat_ws('', slice(below, 2 * j + 1, 2)) AS BINARY), 256)"
    up = f"transform(array(element_at(levels, -1)), below -> transform(sequence(0, (size(below) - 1) div 2), j -> {pair}))"
    steps = f"IF({depth} = 0, CAST(array() AS ARRAY<INT>), sequence(1, {depth}))"
    return F.expr(f"aggregate({steps}, CAST(array({nodes}) AS ARRAY<ARRAY<STRING>>), (levels, i) -> CAST(concat(levels, {up}) AS ARRAY<ARRAY<STRING>>))")


def climbed(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(paths, roots) of trees over ``nodes``: g, pos (from 0), n (nodes of the tree), node, data; ``most`` is the largest n.

    ``paths``: g, pos, node, data, path (the sibling of every level, null where there is none); ``roots``: g, root.
    """
    row = F.struct("pos", "node", "data")
    arrays = nodes.groupBy("g", F.shiftright("pos", LEVELS).alias("block"), "n").agg(F.array_sort(F.collect_list(row)).alias("items"))
    blocks = stash(arrays.withColumn("levels", collapsed("items.node", "n")), "merkle-blocks")
    tops = blocks.select("g", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.expr("element_at(levels, -1)[0]").alias("node"), F.lit(None).cast("string").alias("data"))
    path = "transform(sequence(0, size(levels) - 1), l -> get(get(levels, l), shiftright(CAST(pos & {m} AS INT), l) ^ 1))"
    own = f"IF(size(levels) = 1, CAST(array() AS ARRAY<STRING>), slice({path.format(m=BLOCK - 1)}, 1, size(levels) - 1))"
    if most <= BLOCK:
        roots = tops.select("g", F.col("node").alias("root"))
        return blocks.select("g", "levels", F.inline("items")).select("g", "pos", "node", "data", F.expr(own).alias("path")), roots
    above, roots = climbed(tops, -(-most // BLOCK))
    upper = above.select("g", F.col("pos").alias("block"), F.col("path").alias("upper"))
    rows = blocks.join(upper, ["g", "block"]).select("g", "levels", "upper", F.inline("items"))
    return rows.select("g", "pos", "node", "data", F.concat(F.expr(own), "upper").alias("path")), roots


def folded(leaf: Column, *ways: tuple[Column, Column]) -> Column:
    """The root that a leaf leads to along (path, place) pairs, each from one root to the next."""
    for path, pos in ways:
        steps = F.arrays_zip(path.alias("s"), F.transform(path, lambda _, i: F.call_function("shiftright", pos, i).bitwiseAND(F.lit(1)) == 1).alias("right"))

        def step(acc: Column, x: Column) -> Column:
            s = x["s"]
            return F.when(s.isNull(), digest(acc)).when(x["right"], digest(s, acc)).otherwise(digest(acc, s))

        leaf = F.aggregate(steps, leaf, step)
    return leaf


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, groups, most): ``leaves`` (d, k, leaf, bad) as g, pos, n, node, data; groups as g, k, n; the largest n.

    A group's leaves are ordered by d (null first), then leaf; groups are numbered in the order of k, null first.
    """
    order = [F.col("k").asc_nulls_first(), F.col("d").asc_nulls_first(), F.col("leaf").asc()]
    sorted_ = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stash(sorted_, "merkle-leaves").withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    pieces = stash(rows.groupBy("part", "k").agg(F.min("place").alias("first"), F.count("*").alias("c")), "merkle-pieces")
    groups = global_rank(pieces.groupBy("k").agg(F.sum("c").alias("n")), F.col("k").asc_nulls_first(), name="g").withColumn("g", F.col("g") - 1)
    groups = stash(groups.select("g", "k", "n"), "merkle-groups")
    before = F.sum("c").over(W.partitionBy("p.k").orderBy("part")) - F.col("c")
    numbered = pieces.alias("p").join(small(groups, 40).alias("q"), F.col("p.k").eqNullSafe(F.col("q.k")))
    shifts = stash(numbered.select("g", "n", "part", F.col("p.k").alias("k"), (before - F.col("first")).alias("shift")), "merkle-shifts")
    same = (F.col("r.part") == F.col("s.part")) & F.col("r.k").eqNullSafe(F.col("s.k"))
    met = rows.alias("r").join(small(shifts, 60).alias("s"), same)
    nodes = met.select("g", (F.col("place") + F.col("shift")).alias("pos"), "n", F.col("leaf").alias("node"), F.struct("d", "bad").alias("data"))
    return nodes, groups, groups.agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame, *, fields: list[str], group: str, doc_id: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, k (its group), leaf, subroot, root, path, top_path, folded_root, verified.

    A leaf is the digest of ``fields``.  ``path`` has the siblings up to the subroot, ``top_path`` those from there to the
    root; null stands for a node that is alone.  ``folded_root`` is what the row leads to along them; rows ``where`` fields
    were ``changed`` since (name to column) start from the leaf that they have now, so ``verified`` is false for them.
    Null fields and null groups count, rows that repeat each are a leaf, other columns are ignored, and no rows
    give no rows.
    """
    shared_root(docs.sparkSession)
    leaf = digest(*[framed(F.col(f)) for f in fields])
    now = digest(*[framed((changed or {}).get(f, F.col(f))) for f in fields])
    bad = F.when(where, now) if changed and where is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(group).cast("string").alias("k"), leaf.alias("leaf"), bad.alias("bad"))
    nodes, groups, most = placed(leaves)
    paths, subroots = climbed(nodes, most)
    of_groups = groups.join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(groups.count()).cast("long").alias("n"), F.col("root").alias("node"), F.struct("k").alias("data"))
    top_paths, root = climbed(of_groups, groups.count())
    way = top_paths.join(small(root, 80), "g").select(F.col("pos").alias("g"), F.col("pos").alias("top_pos"), F.col("node").alias("subroot"), F.col("path").alias("top_path"), F.col("data.k").alias("k"), "root")
    rows = paths.join(small(stash(way, "merkle-top"), 2048), "g")
    out = folded(F.coalesce("data.bad", "node"), (F.col("path"), F.col("pos")), (F.col("top_path"), F.col("top_pos")))
    rows = rows.select(F.col("data.d").alias("doc_id"), "k", F.col("node").alias("leaf"), "subroot", "root", "path", "top_path", out.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by lang, where ``n_chars`` of every seventh row (by a checksum of its id) was raised by 1."""
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    where = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], group="lang", changed=changed, where=where)


def proof_digests(rows: DataFrame) -> DataFrame:
    """The rows of :func:`manifest` with the digest of each proof in place of its siblings."""
    proof = F.sha2(F.concat(F.array_join("path", ""), F.array_join("top_path", "")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def oracle() -> str:
    """The whole levels at once, by recursion; a level's nodes are numbered through each group."""
    from siftline.llm.checksum import crc32_sql

    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS l, lang IS NOT NULL AS known, {leaf("n_chars")} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("n_chars + 1")} END AS bad FROM documents
), spots AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY known, l ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY known, l) AS n FROM leaves
), nodes AS (
  SELECT known, l, 0 AS level, i, n, leaf AS h FROM spots
  UNION ALL
  SELECT known, l, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY known, l, level, i // 2
), subroots AS (
  SELECT known, l, h AS subroot, row_number() OVER (ORDER BY known, l) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2
), levels AS (
  SELECT DISTINCT known, l, level FROM nodes WHERE n > 1
), path AS MATERIALIZED (
  SELECT s.doc_id, s.leaf, v.level AS k, (s.i >> v.level) & 1 AS bit, o.h AS sib FROM spots s JOIN levels v ON v.known = s.known AND v.l = s.l
    LEFT JOIN nodes o ON o.known = s.known AND o.l = s.l AND o.level = v.level AND o.i = xor(s.i >> v.level, 1)
  UNION ALL
  SELECT s.doc_id, s.leaf, 1000 + v.level, (r.i >> v.level) & 1, o.h FROM spots s JOIN subroots r ON r.known = s.known AND r.l = s.l CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) v
    LEFT JOIN tops o ON o.level = v.level AND o.i = xor(r.i >> v.level, 1)
), steps AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY k) AS step FROM path
), fold AS (
  SELECT doc_id, leaf, 0 AS step, coalesce(bad, leaf) AS h FROM spots
  UNION ALL
  SELECT f.doc_id, f.leaf, f.step + 1, sha256(CASE WHEN s.sib IS NULL THEN f.h WHEN s.bit = 1 THEN s.sib || f.h ELSE f.h || s.sib END)
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.step = f.step + 1
), ends AS (
  SELECT doc_id, leaf, h AS folded_root FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY step DESC) = 1
), proofs AS (
  SELECT doc_id, leaf, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY doc_id, leaf
)
SELECT s.doc_id, s.leaf, r.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM spots s JOIN subroots r ON r.known = s.known AND r.l = s.l JOIN ends e ON e.doc_id = s.doc_id AND e.leaf = s.leaf
LEFT JOIN proofs p ON p.doc_id = s.doc_id AND p.leaf = s.leaf CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
