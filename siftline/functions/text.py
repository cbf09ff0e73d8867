"""Text functions: normal forms, shingles, tokens, similarity.  All but NFKC are built-in column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for the JVM's regular expressions.
SPACE = r"(?U)\s+"
#: Texts of a batch that Python holds at once.
FEW = 256


def strip_spaces(text: Column) -> Column:
    """Without any white space (X3 without the case)."""
    return F.regexp_replace(text, SPACE, "")


def dedup_normal(text: Column) -> Column:
    """Lower case, no white space.  Null stays null."""
    return F.lower(strip_spaces(text))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; no built-in function has it, so batches go through Arrow, a few texts at a time as Python's."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        few = (texts.slice(at, FEW).to_pylist() for at in range(0, len(texts), FEW))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in few)])

    return run(text)


def overlap_normal(text: Column, compatibility: bool = True) -> Column:
    """NFKC, lower case, letters and numbers only.  Without ``compatibility`` NFKC is left out."""
    return F.regexp_replace(F.lower(nfkc(text) if compatibility else text), r"[^\p{L}\p{N}]", "")


def shingles(text: Column, n: int = 3, empty: str = "none", short_at: int | None = None) -> Column:
    """The distinct ``n``-character shingles of a normalised text.

    A text of at most ``short_at`` characters (``n`` if not given) is its own single shingle.  The empty text has
    no shingle, or with ``empty="self"`` the empty shingle.  X4 is the default; X6 is ``empty="self"`` and
    ``short_at=n-1``.
    """
    size, limit = F.char_length(text), n if short_at is None else short_at
    none = F.array().cast("array<string>") if empty == "none" else F.array(F.lit(""))
    return F.when(size == 0, none).when(size <= max(limit, n - 1), F.array(text)).otherwise(F.array_distinct(windows(text, n)))


def windows(text: Column, n: int) -> Column:
    """All ``n``-character substrings in order, for texts of ``n`` characters or more.

    The text is split into characters once; a substring of a long UTF-8 text would be counted off from its start.
    """

    def cut(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    return F.get(F.transform(F.array(F.split(text, "")), cut), F.lit(0))


def shingle_keys(text: Column, own_size: int = 3, empty: bool = False) -> Column:
    """The distinct 3-character shingles as sorted numbers (21 bits a character), by an Arrow batch function.

    A text of at most ``own_size`` characters is its own shingle; with ``empty`` the empty text is one too (0).
    """

    @F.pandas_udf("array<bigint>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, own_size, empty) for t in batch], dtype=object)

    return run(text)


def shingle_set(t: str | None, own_size: int = 3, empty: bool = False) -> np.ndarray:
    c = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    if len(c) > max(own_size, 2):
        return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
    return np.array([sum(int(x) << (42 - 21 * i) for i, x in enumerate(c))] if len(c) or empty else [], np.int64)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lsh_hit_probability(similarity: Column | float, rows: int, bands: int) -> Column:
    """X11: the chance that two sets of this similarity share a band."""
    s = similarity if isinstance(similarity, Column) else F.lit(similarity)
    return 1 - F.pow(1 - F.pow(s, rows), bands)


def text_hash(text: Column) -> Column:
    """A 64-bit hash that other engines can form too: the first half of the MD5, taken as 60 bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """A repeatable pseudorandom order: MD5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def retrieval_tokens(text: Column) -> Column:
    """Words of a-z and 0-9 whole; Han runs as every character and every pair of characters.  Repeats kept."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def parts(run: Column) -> Column:
        size = F.char_length(run)
        ones = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(run, i, F.lit(1)))
        twos = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1)), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[a-z0-9]"), F.array(run)).otherwise(F.concat(ones, twos))

    han = text.rlike(r"[\x{4e00}-\x{9fff}]")  # without any, words are all there is
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.when(han, F.flatten(F.transform(runs, parts))).otherwise(plain), F.array().cast("array<string>"))


#: Phrases and particles that carry no topic in a question.
STOP_PHRASES = r"请问|介绍一下|有哪些|有什么|推荐|我想|可以|什么|一下|哪里|怎样|是否|[的是有了吗呢]"


def without_place(question: Column, place: Column) -> Column:
    """X20, first half: the question without the place's name, with or without its 市."""
    short = F.regexp_replace(place, "市$", "")
    return F.replace(F.replace(question, place, F.lit("")), short, F.lit(""))


def searchable(question: Column) -> Column:
    """X20, second half: without stop phrases and particles."""
    return F.regexp_replace(question, STOP_PHRASES, "")


def split_list(text: Column) -> Column:
    """Split at the first kind of separator that occurs, of ``，`` ``,`` ``、``; parts trimmed, empty ones left out."""

    def by(mark: str) -> Column:
        return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")

    whole = F.filter(F.array(F.trim(text)), lambda x: x != "")
    return F.when(text.contains("，"), by("，")).when(text.contains(","), by(",")).when(text.contains("、"), by("、")).otherwise(whole)


def clip(text: Column, size: int) -> Column:
    """The first ``size`` characters."""
    return F.left(text, F.lit(size))


def clean_cell(text: Column) -> Column:
    """K8: tabs and line ends as blanks, for one cell of a TSV."""
    return F.translate(text, "\t\n\r", "   ")
