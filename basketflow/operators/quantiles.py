"""Exact quantiles with linear interpolation, for tables of any size.

Quantiles of whole columns are found by narrowing: a bracket of two values
holds the wanted rank, sampled values inside it become probes, and one pass
counts exactly how many rows lie below and at each probe.  Only values of a
last, small bracket are sorted.  Nothing is shuffled but those and a few sums.
Medians per key count equal values and find the ranks in a running total.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.operators.ordering import running_total
from basketflow.session import Scratch

SORTED = 20_000  # rows of a bracket whose values the driver sorts
SAMPLED = 2_000  # sampled values per bracket and round


def _interpolated(prob: float) -> Column:
    """Quantile from rows of ``_value``, their count ``_n``, rows before ``_before`` and ``_total``."""
    place = (F.col("_total") - 1) * F.lit(float(prob))
    end = F.col("_before") + F.col("_n")
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < end), F.col("_value")))
    share = F.max(place - F.floor(place))
    low, high = at(F.floor(place)), at(F.ceil(place))
    # An infinite neighbor must not turn a share of nothing into NaN.
    return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)


def _placed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value counts with the rows of their keys before each value and in all."""
    return running_total(counts, keys, [F.col("_value")], "_n", "_before", "_total")


@dataclass
class _Bracket:
    """Where a rank lies: strictly between two values, with the rows up to the lower and below the upper one."""

    column: str
    rank: int
    upto: int
    below: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        held = F.col(self.column).isNotNull()
        held = held if self.low is None else held & (F.col(self.column) > F.lit(self.low))
        return held if self.high is None else held & (F.col(self.column) < F.lit(self.high))

    def narrow(self, probe: float, below: int, upto: int) -> None:
        """With the exact numbers of rows below and up to a probe."""
        if below <= self.rank < upto:
            self.value = probe
        elif self.rank < below and below <= self.below:
            self.high, self.below = probe, below
        elif upto <= self.rank and upto >= self.upto:
            self.low, self.upto = probe, upto


def _listed(rows: DataFrame, brackets: list[_Bracket], share: list[float] | None, seed: int) -> dict[int, list[tuple[float, int]]]:
    """Per bracket its values with their counts in order; with ``share`` of a sample of its rows."""
    marks = []
    for i, b in enumerate(brackets):
        chosen = b.inside() if share is None else b.inside() & (F.rand(seed + i) < F.lit(share[i]))
        marks.append(F.when(chosen, F.struct(F.lit(i).alias("at"), F.col(b.column).alias("value"))))
    found = rows.select(F.inline(F.array_compact(F.array(*marks)))).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(brackets))}
    for at, value, n in zip(*(found[c].to_pylist() for c in ("at", "value", "n")), strict=True):
        out[at].append((value, n))
    return {i: sorted(values) for i, values in out.items()}


def _probes(bracket: _Bracket, sample: list[tuple[float, int]]) -> set[float]:
    """The sampled values around the bracket's rank, far enough from it to hold it most times."""
    values = [v for v, n in sample for _ in range(n)]
    if not values:
        return set()
    place = (bracket.rank - bracket.upto) / (bracket.below - bracket.upto) * len(values)
    reach = 2 * math.sqrt(len(values))
    return {values[min(len(values) - 1, max(0, int(place + d)))] for d in (-reach, 0, reach)}


def _ranked(rows: DataFrame, brackets: list[_Bracket]) -> None:
    """Finds the value of every bracket; each round samples and counts the open ones, two passes over the narrow ``rows``."""
    turn = 0
    while True:
        open_ = [b for b in brackets if b.value is None]
        small = [b for b in open_ if b.below - b.upto <= SORTED]
        if small:
            for i, values in _listed(rows, small, None, 0).items():
                left = small[i].rank - small[i].upto
                for value, n in values:
                    if left < n:
                        small[i].value = value
                        break
                    left -= n
        wide = [b for b in open_ if b.value is None]
        if not wide:
            return
        turn += 1
        samples = _listed(rows, wide, [min(1.0, SAMPLED / (b.below - b.upto)) for b in wide], 1000 * turn)
        probes = sorted({(b.column, p) for i, b in enumerate(wide) for p in _probes(b, samples[i])})
        if not probes:
            continue
        sums = [F.sum((F.col(c) < F.lit(p)).cast("long")) for c, p in probes] + [F.sum((F.col(c) <= F.lit(p)).cast("long")) for c, p in probes]
        counted = rows.agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first()
        for i, (column, probe) in enumerate(probes):
            for b in wide:
                if b.column == column and b.value is None:
                    b.narrow(probe, counted[i], counted[len(probes) + i])


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], stored: bool = False) -> DataFrame:
    """One row; per name an array with the quantiles of that column (nulls and NaN left out, null without values).

    The columns are settled once, unless ``df`` is ``stored`` as it is; the ranks of all columns are narrowed together.
    """
    spark = df.sparkSession
    columns = {name: f"v{i}" for i, name in enumerate(values)}
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    with Scratch(spark) as scratch:
        rows = df.select(*[number(col).alias(columns[name]) for name, col in values.items()])
        rows = rows if stored else scratch.settle(rows)
        total = rows.agg(*[F.count(c).alias(c) for c in columns.values()]).first()
        places = {name: [(total[c] - 1) * float(p) for p in probs] for name, c in columns.items() if total[c]}
        wanted = {(name, r) for name, ps in places.items() for p in ps for r in (math.floor(p), math.ceil(p))}
        brackets = {(name, r): _Bracket(columns[name], r, 0, total[columns[name]]) for name, r in sorted(wanted)}
        _ranked(rows, list(brackets.values()))
    found = {}
    for name, ps in places.items():
        found[name] = []
        for p in ps:
            low, high, share = brackets[name, math.floor(p)].value, brackets[name, math.ceil(p)].value, p - math.floor(p)
            # an infinite neighbor must not turn a share of nothing into NaN
            found[name].append(low if share == 0 else low * (1 - share) + high * share)
    kinds = ", ".join(f"`{name}` array<double>" for name in values)
    return spark.createDataFrame([tuple(found.get(name) for name in values)], kinds)


def grouped_prices(df: DataFrame, keys: Sequence[str], value: str, median: str, mean: str, count: str) -> DataFrame:
    """Median and mean of ``value`` and the number of rows per key, from one shuffle of the rows.

    Equal values are counted first, so what is laid out in order are distinct
    values; rows without a value count as rows.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_n", F.when(F.col("_value").isNotNull(), F.col("_rows")).otherwise(F.lit(0)))
    mean_of = F.sum(F.col("_value") * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))
    return _placed(counts, keys).groupBy(*keys).agg(_interpolated(0.5).alias(median), mean_of.alias(mean), F.sum("_rows").alias(count))


def grouped_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of ``value`` per key; values are counted first, so the shuffle carries distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value"))
    counts = counts.agg(F.count(F.lit(1)).alias("_n"))
    return _placed(counts, keys).groupBy(*keys).agg(_interpolated(0.5).alias(name))
