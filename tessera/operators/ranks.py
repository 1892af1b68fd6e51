"""Exact order statistics of large columns, without a task that holds or sorts them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass counts.
RANGES = 1024


def at_ranks(values: DataFrame, col: str, ranks: list[int], most: int = 50_000) -> dict[int, float]:
    """The values of a numeric column at ranks (from 0) in ascending order. Nulls and NaN have no rank.

    Each pass counts the values of `RANGES` ranges between the least and greatest left, with the least and greatest of
    each, and goes on within the range that holds the rank. It ends where that is a single value, however often it
    comes, or `most` rows, which are sorted. The driver sees counts; ranks close together share their passes.
    """
    x = F.col(col).cast("double")
    rows = values.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    out: dict[int, float] = {}
    todo: dict[tuple[float, float, int], list[int]] = {}
    lo, hi, n = rows.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    wanted = sorted({r for r in ranks if 0 <= r < n})
    if wanted:
        todo[(lo, hi, 0)] = wanted
    while todo:
        (lo, hi, before), inside = todo.popitem()
        if lo == hi:
            out |= dict.fromkeys(inside, lo)
            continue
        part = rows.where(F.col("x").between(lo, hi))
        width = (hi / 2 - lo / 2) / RANGES
        place = F.least(F.floor((F.col("x") / 2 - lo / 2) / width), F.lit(RANGES - 1)) if width > 0 else F.when(F.col("x") == lo, 0).otherwise(1)
        found = part.groupBy(place.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(found, key=lambda r: r["b"]):
            own = [k for k in inside if before <= k < before + r["n"]]
            if own and r["n"] <= most and r["lo"] < r["hi"]:
                first = [v["x"] for v in rows.where(F.col("x").between(r["lo"], r["hi"])).orderBy("x").limit(own[-1] - before + 1).collect()]
                out |= {k: first[k - before] for k in own}
            elif own:
                todo[(r["lo"], r["hi"], before)] = own
            before += r["n"]
    return out


def percentile(values: DataFrame, col: str, share: float, n: int | None = None) -> float | None:
    """The share-th quantile with linear interpolation between two ranks; None without values."""
    if n is None:
        n = values.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    found = at_ranks(values, col, [low, high])
    return found[low] + (found[high] - found[low]) * (place - low)
