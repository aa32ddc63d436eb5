"""Scalar building blocks as column expressions: all of them run inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code sets of the pitch vocabulary.
SWINGS = ("swinging_strike", "foul", "in_play")
STRIKES = ("swinging_strike", "called_strike", "foul")
HITS = ("single", "double", "triple", "home_run")
OUTS = ("field_out", "strikeout", "force_out")
TOTAL_BASES = {"single": 1, "double": 2, "triple": 3, "home_run": 4}


def ratio(num: Column, den: Column) -> Column:
    """num / den in double precision; NULL where den is 0 or NULL."""
    d = den.cast("double")
    return num.cast("double") / F.when(d != 0, d)


def number(col: Column) -> Column:
    """A float column as double, NaN read as missing."""
    d = col.cast("double")
    return F.when(~F.isnan(d), d)


def clamp(col: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def first_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """The label of the first rule that holds; NULL if none does, so that unknown codes fail a NOT NULL load instead of passing as something."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out


def pitch_class(outcome: Column, event: Column, strikes: Column) -> Column:
    """Class of a pitch: the event decides first, then two-strike fouls, then the outcome."""
    return first_match([
        (event == "hit_by_pitch", "hit_by_pitch"), (outcome == "in_play", "in_play"), ((outcome == "foul") & (strikes == 2), "foul_two_strikes"), (outcome == "foul", "foul"),
        (outcome == "swinging_strike", "whiff"), (outcome == "called_strike", "called_strike"), (outcome == "ball", "ball"),
    ])


def any_of(*flags: Column) -> Column:
    """OR in which a NULL flag counts as false."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def packed_key(*parts: tuple[Column, int]) -> Column:
    """Zero-padded parts side by side as one BIGINT; the first part is not padded."""
    (head, _), *rest = parts
    return F.concat(head.cast("string"), *[F.lpad(c.cast("string"), width, "0") for c, width in rest]).cast("long")


def recency_weight(season: Column, reference: Column) -> Column:
    """2 for the two newest seasons, 0.75 times as much for each one older, at least 0.25."""
    age = (reference - season).cast("double")
    return F.when(age <= 1, F.lit(2.0)).otherwise(F.greatest(F.lit(0.25), F.lit(2.0) * F.pow(F.lit(0.75), age - 1)))


def leverage(inning: Column, diff: Column, runners: Column, outs: Column) -> Column:
    """Product of inning, score, runners and outs factors."""
    stage = F.when(inning <= 3, 0.6).when(inning <= 6, 0.9).when(inning <= 8, 1.3).otherwise(1.5)
    score = F.greatest(F.lit(0.3), F.lit(1.5) - F.lit(0.24) * F.least(F.abs(diff), F.lit(5)))
    return stage * score * (F.lit(1.0) + F.lit(0.15) * F.bit_count(runners)) * F.when(outs == 2, 1.1).otherwise(1.0)


def leverage_bucket(inning: Column, diff: Column) -> Column:
    return F.when((F.abs(diff) <= 1) & (inning >= 7), "high").when((F.abs(diff) >= 4) | (inning <= 5), "low").otherwise("mid")


def bases(runners: Column) -> list[Column]:
    """Occupied first, second and third base of a three-bit state."""
    return [(F.shiftright(runners, i).bitwiseAND(1)) == 1 for i in range(3)]


def mixed_radix(*digits: tuple[Column, int]) -> Column:
    """One integer of digits with the given radices, the first digit slowest; out-of-range or NULL digits give NULL."""
    out, ok = F.lit(0), F.lit(True)
    for digit, radix in digits:
        out, ok = out * radix + digit.cast("int"), ok & digit.between(0, radix - 1)
    return F.when(ok, out)


def shrink(value: Column, n: Column, prior: Column, n0: Column | float) -> Column:
    """Empirical-Bayes mean a x + (1 - a) prior with a = n / (n + n0); a missing value is the prior."""
    n0 = F.lit(float(n0)) if isinstance(n0, (int, float)) else n0
    a = n.cast("double") / (n + n0)
    return F.when(value.isNull() | n.isNull(), prior).otherwise(a * value + (1 - a) * prior)


def ladder(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the right-closed bin (edges[i], edges[i + 1]] that holds the value; NULL outside."""
    out = F.lit(None)
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Half-open bins of equal width, the last one closed; outside values go to the end bins."""
    width = (high - low) / bins
    return clamp(F.floor((value - F.lit(low)) / F.lit(width)).cast("int"), 0, bins - 1)


def digest(*parts: Column) -> Column:
    """SHA-256 of normalised parts in fixed order; NULL differs from every text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.lower(F.trim(p.cast("string")))), F.lit("~")) for p in parts]), 256)


def hashed_uniform(*parts: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1) from a key: the leading 13 hex digits of an MD5, which any engine can compute."""
    text = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rbf(a: Mapping[str, Column], b: Mapping[str, Column], weights: Mapping[str, float], sigma: float) -> Column:
    """exp(-sum w d^2 / 2 sigma^2) with weights that sum to 1 (equal ones if all are 0); a missing difference counts 0."""
    total = sum(weights.values())
    w = {k: (v / total if total else 1 / len(weights)) for k, v in weights.items()}
    d2 = sum((F.lit(w[k]) * F.coalesce((a[k] - b[k]) * (a[k] - b[k]), F.lit(0.0)) for k in weights), F.lit(0.0))
    return F.exp(-d2 / F.lit(2 * sigma * sigma))


def masked_rbf(a: Mapping[str, Column], b: Mapping[str, Column], weights: Mapping[str, float], sigma: float) -> Column:
    """As rbf, but a feature missing on either side drops out and the other weights are scaled up; NULL if all drop out."""
    d2, kept = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        both = a[k].isNotNull() & b[k].isNotNull()
        d2 = d2 + F.when(both, F.lit(float(w)) * (a[k] - b[k]) * (a[k] - b[k])).otherwise(0.0)
        kept = kept + F.when(both, F.lit(float(w))).otherwise(0.0)
    return F.when(kept > 0, F.exp(-(d2 / kept) / F.lit(2 * sigma * sigma)))
