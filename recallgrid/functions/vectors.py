"""Vector expressions on array columns: sums run in double, whatever the element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter vector's dimensions."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either norm is (nearly) 0."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-12, dot(a, b) / size).otherwise(F.lit(0.0))


def confidence(cos: Column) -> Column:
    return (cos + 1) / 2


def rounded(x: Column, places: int = 6) -> Column:
    """The scaled double rounded half away from zero: half of a value of six decimals is a tie, which F.round breaks by its shortest decimal form."""
    scale = float(10**places)
    return F.round(x * scale, 0) / scale


def normalised(v: Column) -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def compose(a: Column, b: Column) -> Column:
    """Elementwise product over the shorter length, normalised."""
    n = F.least(F.size(a), F.size(b))
    return normalised(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def quantise(v: Column, bits: int = 8) -> Column:
    """Codes 0 .. 2**bits - 1 over the vector's own range; constant vectors get 0."""
    low, high, top = F.array_min(v).cast("double"), F.array_max(v).cast("double"), float((1 << bits) - 1)
    return F.transform(v, lambda x: F.when(high > low, F.floor((x.cast("double") - low) * top / (high - low)).cast("int")).otherwise(F.lit(0)))


def dequantise(codes: Column, low: Column, high: Column, bits: int = 8) -> Column:
    return F.transform(codes, lambda c: low + c * (high - low) / float((1 << bits) - 1))


def run_lengths(v: Column, longest: int = 255) -> Column:
    """Runs (n, value) of equal neighbours, none longer than ``longest``."""
    kind = "array<struct<n:int,value:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["value"]) == x.cast("double")) & (F.when(F.size(acc) > 0, last["n"]) < longest)
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["n"] + 1).alias("n"), x.cast("double").alias("value"))))
        return F.when(same, longer).otherwise(F.concat(acc, F.array(F.struct(F.lit(1).alias("n"), x.cast("double").alias("value")))))

    return F.aggregate(v, F.array().cast(kind), step)


def expand_runs(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))
