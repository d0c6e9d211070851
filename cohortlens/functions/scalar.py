"""Dates, arithmetic, buckets and dummy coding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cohortlens.functions import lexicons as L
from cohortlens.functions.text import fold


def date_parts(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "year": F.year(ts), "is_weekend": F.weekday(ts) >= 5}


def from_epoch(c: Column) -> Column:
    return F.timestamp_seconds(c)


def log_ratio(part: Column, reference: Column, eps: float = 1e-6) -> Column:
    """Additive log ratio of two shares."""
    return F.log((part + eps) / (reference + eps))


def fisher_z(r: Column, limit: float = 0.999999) -> Column:
    return F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), r)))


def clipped(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def log_odds(p_a: Column, p_b: Column, eps: float = 1e-10) -> Column:
    return F.log((p_a + eps) / (p_b + eps))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 folded into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


# ---- effect size labels and helpers ---------------------------------------------------------


def d_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def f2_label(f2: Column) -> Column:
    return F.when(f2 < 0.02, "negligible").when(f2 < 0.15, "small").when(f2 < 0.35, "medium").otherwise("large")


def f_squared(r2: Column) -> Column:
    return F.try_divide(r2, 1 - r2)


def d_from_t(t: Column, df: Column) -> Column:
    return 2 * F.abs(t) / F.sqrt(df)


def significance(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha


# ---- age and gender -------------------------------------------------------------------------


def declaration_text(text: Column) -> Column:
    """Folded lower-case text the declaration patterns run on; keep it in a column of its own."""
    return fold(F.lower(F.coalesce(text, F.lit(""))))


def declared_age(low: Column, strict: bool = False) -> Column:
    """First pattern whose first match is 13–80; strict mode skips statements about the past."""
    tries = []
    for p in L.AGE_PATTERNS:
        if strict and p in L.AGE_PATTERNS_PAST:
            continue
        age = F.regexp_extract(low, "(?i)" + p, 1).try_cast("int")
        tries.append(F.when(age.between(13, 80), age))
    return F.coalesce(*tries)


def declared_gender(low: Column, strict: bool = False) -> Column:
    table = L.GENDER_PATTERNS_STRICT if strict else L.GENDER_PATTERNS
    out = F
    for gender, patterns in table.items():
        out = out.when(low.rlike("(?i)(?:" + "|".join(patterns) + ")"), gender)
    return out


def age_bucket(age: Column) -> Column:
    out = F
    for label, lo, hi in L.AGE_BUCKETS:
        out = out.when(age.between(lo, hi), label)
    return out.otherwise("unknown")


def three_bucket(bucket: Column) -> Column:
    out = F
    for k, v in L.BUCKET_TO_THREE.items():
        out = out.when(bucket == k, v)
    return out


def binary_bucket(bucket: Column) -> Column:
    return F.when(bucket == "13-18", "teen").otherwise("adult")


def cut(c: Column, cuts: Sequence, labels: Sequence[str]) -> Column:
    """labels[i] for the first i with c < cuts[i], else the last label."""
    out = F
    for limit, label in zip(cuts, labels):
        out = out.when(c < limit, label)
    return F.when(c.isNotNull(), out.otherwise(labels[-1]))


# ---- dummy coding ---------------------------------------------------------------------------


def dummies(c: str, levels: Sequence[str], reference: str, prefix: str) -> dict[str, Column]:
    """0/1 columns for every level but the reference; hyphens become underscores."""
    return {
        f"{prefix}{lvl.replace('-', '_')}": F.coalesce((F.col(c) == lvl).cast("double"), F.lit(0.0))
        for lvl in levels
        if lvl != reference
    }


def interactions(left: Sequence[str], right: Sequence[str]) -> dict[str, Column]:
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a in left for b in right}


#: Coefficients of Wichura's rational approximation of the normal quantile (AS 241), lowest power first, for
#: the middle, the tails and the far tails.
NORMAL_QUANTILE = (
    (
        (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
        (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    ),
    (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)


def _polynomial(r: Column, coefficients) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * r + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of a share inside (0, 1), to about 16 digits; infinite at the ends, null outside."""
    middle, tail, far = NORMAL_QUANTILE
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.log(F.least(p, 1 - p)))
    centre = q * _polynomial(r, middle[0]) / _polynomial(r, middle[1])
    side = F.when(t <= 5, _polynomial(t - 1.6, tail[0]) / _polynomial(t - 1.6, tail[1])).otherwise(_polynomial(t - 5, far[0]) / _polynomial(t - 5, far[1]))
    ends = F.when(p == 0, float("-inf")).when(p == 1, float("inf"))
    inside = F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * side)
    return F.when((p > 0) & (p < 1), inside).otherwise(ends)
