"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import dims


def platt(score: Column, a: float = dims.PLATT_A, b: float = dims.PLATT_B) -> Column:
    return 1.0 / (1.0 + F.exp(F.lit(a) * score + F.lit(b)))


def dot(x: Column, y: Column) -> Column:
    """Inner product in doubles, added up in order."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(x) * norm(y)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(x, y), n))


def risk_band(score: Column) -> Column:
    out = None
    for least, name in dims.RISK_BANDS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, F.lit(name))
    return out


def rrf(semantic_rank: Column, keyword_rank: Column, w_semantic: float = 0.5, w_keyword: float = 0.5, k: int = dims.RRF_K) -> Column:
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(k)) + r), F.lit(0.0))
    return part(w_semantic, semantic_rank) + part(w_keyword, keyword_rank)


def boost(conf: Column, n_subject: Column, n_object: Column, n_contracts: Column) -> Column:
    """Confidence raised by how many contracts hold the triple's ends."""
    base = F.coalesce(F.nullif(conf, F.lit(0.0)), F.lit(dims.DEFAULT_CONFIDENCE))
    raised = F.least(F.lit(1.0), base + F.try_divide(n_subject + n_object, F.lit(2.0) * n_contracts) * 0.2)
    return F.when(n_contracts <= 1, base).otherwise(raised)


def round_half_even(x: Column, digits: int = 1) -> Column:
    """A double rounded by its exact binary value, halves to the even digit, as Python's round does; 12.25 gives 12.2, and 12.35, which is a little less, 12.3.

    The value is split into two parts of half its bits, whose multiples are exact, so its distance from the half between two results has a true sign.
    Where doubles lie farther apart than results, a value is its own result.
    """
    scale = 10.0**digits
    a = F.abs(x)
    head = a * 134217729.0 - (a * 134217729.0 - a)
    low = F.floor(a * scale).cast("double")
    beyond = (head * (2 * scale) - (low * 2 + 1)) + (a - head) * (2 * scale)
    up = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(F.pmod(low, F.lit(2.0)))
    out = (low + up) / scale
    return F.when(F.isnan(x) | (a * scale >= 2.0**52), x).when(x < 0, -out).otherwise(out)
