"""Label-quality signals: agreement, confidence, difficulty, quality, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import jaccard

#: Weights of consistency, confidence and disagreement; band edges; parts of the quality score.
DIFFICULTY_WEIGHTS = (0.40, 0.30, 0.30)
BANDS = (("easy", 0.34), ("medium", 0.67))
QUALITY = (0.55, 0.25, 0.20)


def difficulty(consistency: Column, confidence: Column, agreement: Column, weights=DIFFICULTY_WEIGHTS) -> Column:
    """The weighted mean of ``1 - signal`` over the signals that are there; 0.5 if none is."""
    signals = list(zip((consistency, confidence, agreement), weights))
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals), F.lit(0.0))
    missed = sum((F.coalesce(w * (1 - s), F.lit(0.0)) for s, w in signals), F.lit(0.0))
    return F.when(total > 0, missed / total).otherwise(F.lit(0.5))


def quality(valid: Column, confidence: Column, agreement: Column, parts=QUALITY) -> Column:
    """0 if invalid, else a base plus shares of confidence and agreement, 0.5 each if missing; 4 places."""
    base, c, a = parts
    return F.when(valid, F.round(base + c * F.coalesce(confidence, F.lit(0.5)) + a * F.coalesce(agreement, F.lit(0.5)), 4)).otherwise(F.lit(0.0))


def band(value: Column, bands=BANDS, last: str = "hard") -> Column:
    """The name of the first band whose edge is above the value."""
    out = F.when(value < bands[0][1], bands[0][0])
    for name, edge in bands[1:]:
        out = out.when(value < edge, name)
    return out.otherwise(last)


def mean_logprob(logprobs: Column) -> Column:
    """The mean; null for an empty array."""
    return F.when(F.size(logprobs) > 0, F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs))


def interpolated(values: Column, q: float) -> Column:
    """A10: linear interpolation at ``q * (n - 1)`` of the sorted array; null for an empty array."""
    s, at = F.array_sort(values), q * (F.size(values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(s, low), F.get(s, high)
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def confidence(logprobs: Column, q: float = 0.1) -> Column:
    """Exp of the q-th percentile, rounded to 4 places; exp of the mean where there is no percentile."""
    return F.coalesce(F.round(F.exp(interpolated(logprobs, q)), 4), F.exp(mean_logprob(logprobs)))


def length_adjusted_confidence(mean: Column, tokens: Column) -> Column:
    """exp(mean) to the power of 1 over the logarithm of the length, which counts as 10 tokens at least."""
    return F.pow(F.exp(mean), 1 / F.greatest(F.lit(1.0), F.log10(tokens + 10)))


def pairs_of(fields: dict[str, Column], slots: Column) -> Column:
    """``name=value`` for each non-null field, and ``slot.key=value`` for each non-null slot of a string map."""
    own = F.array_compact(F.array(*[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()]))
    extra = F.transform(F.filter(F.map_entries(slots), lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit("slot."), e["key"], F.lit("="), e["value"]))
    return F.array_distinct(F.concat(own, F.coalesce(extra, F.array().cast("array<string>"))))


def field_agreement(a: Column, b: Column) -> Column:
    """Jaccard of two pair sets."""
    return jaccard(a, b)


def pairwise_consistency(samples: Column) -> Column:
    """The mean Jaccard over all pairs of an array of pair sets, nulls left out; null for fewer than two."""
    s = F.filter(samples, lambda x: x.isNotNull())
    n = F.size(s)
    rows = F.transform(s, lambda x, i: F.aggregate(F.slice(s, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda t, y: t + jaccard(x, y)))
    total = F.aggregate(rows, F.lit(0.0), lambda t, x: t + x)
    return F.when(n >= 2, total / (n * (n - 1) / 2))


def json_bytes(value: Column) -> Column:
    """A5: bytes of a value as JSON with a blank after each comma and colon outside of strings."""
    text = F.to_json(value)
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    return F.octet_length(text) + F.char_length(F.regexp_replace(bare, "[^,:]", ""))
