"""Exact positions of rows within groups, by range partitions and their offsets.

Rows are range-partitioned by (group, value, spread), so a group, or one value that a third of all rows share, is
dealt out over as many partitions as it needs. Inside a partition a window gives each row its place among the
group's rows there; one small row per partition and group tells how many come before and how many rows of its
first and last value lie in neighbouring partitions. Rows meet that summary on (partition, group), never on a
value, so no key is hotter than a partition. Rows without a value are staged with the others and pass beside the rest.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from prudens.plans.staging import stage

_SUMMARY = ("transform(parts, x -> struct(x._part as _part, aggregate(filter(parts, y -> y._part < x._part), 0L, (t, y) -> t + y.n) as _off,"
            " aggregate(filter(parts, y -> y._part < x._part and y.hi = x.lo), 0L, (t, y) -> t + y.n_hi) as _same_before,"
            " aggregate(filter(parts, y -> y._part > x._part and y.lo = x.hi), 0L, (t, y) -> t + y.n_lo) as _same_after,"
            " x.lo as _lo, x.hi as _hi, aggregate(parts, 0L, (t, y) -> t + y.n) as n_total))")


class Positions:
    """``rows``: the non-null rows with n_below, n_eq and n_total; ``nulls``: the others."""

    def __init__(self, df: DataFrame, keys: list[str], value: str, spread: list[str] = (), partitions: int | None = None):
        self.keys, self.value, self.columns = keys, value, df.columns
        #: All rows as staged, sorted into partitions.
        self.source = stage(df.repartitionByRange(*([partitions] if partitions else []), *keys, value, *spread).withColumn("_part", F.spark_partition_id()), "ranged")
        self.nulls, placed = self.source.where(F.col(value).isNull()).select(*df.columns), self.source.where(F.col(value).isNotNull())
        here = [F.col("_part"), *[F.col(k) for k in keys]]
        own = Window.partitionBy(*here).orderBy(value)
        below = F.rank().over(own) - 1
        upto = F.count(F.lit(1)).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        self._local = placed.select("*", below.cast("long").alias("_below"), upto.alias("_upto"))
        size = F.col("_upto") - F.col("_below")
        per = self._local.groupBy(*here).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by(size, value).alias("n_lo"), F.max_by(size, value).alias("n_hi"))
        whole = per.groupBy(*keys) if keys else per.groupBy(F.lit(0).alias("_all"))
        gathered = whole.agg(F.sort_array(F.collect_list(F.struct("_part", "n", "lo", "hi", "n_lo", "n_hi"))).alias("parts"))
        #: One row per partition and group; groups that lie in many partitions are few.
        self.summary = gathered.selectExpr(*[f"`{k}`" for k in keys], f"inline({_SUMMARY})")

    def _met(self, summary: DataFrame) -> DataFrame:
        return self._local.join(summary, ["_part", *self.keys])

    def _placed(self, met: DataFrame, more: list[str] = ()) -> DataFrame:
        first, last = F.col(self.value) == F.col("_lo"), F.col(self.value) == F.col("_hi")
        before, after = F.when(first, F.col("_same_before")).otherwise(0), F.when(last, F.col("_same_after")).otherwise(0)
        return met.select(*[F.col(f"`{c}`") for c in self.columns], (F.col("_off") + F.col("_below") - before).alias("n_below"),
                          (F.col("_upto") - F.col("_below") + before + after).alias("n_eq"), "n_total", *more)

    @property
    def rows(self) -> DataFrame:
        return self._placed(self._met(self.summary))

    def quantiles(self, probs: dict[str, float]) -> DataFrame:
        """Linear-interpolation quantiles (position ``(n - 1) * q``) of each group, one row each."""
        # a partition knows which of the wanted positions it holds; all others give nothing to the sums
        met = self._met(self.summary)
        aggs, outs = [F.max("n_total").alias("n_total")], []
        for name, q in probs.items():
            at = (F.col("n_total") - 1) * F.lit(float(q))
            lo = F.floor(at)
            hi = F.least(lo + 1, F.col("n_total") - 1)
            holds = lambda k: (F.col("_off") + F.col("_below") <= k) & (F.col("_off") + F.col("_upto") > k)
            aggs += [F.max(F.when(holds(lo), F.col(self.value))).alias(f"_{name}_lo"), F.max(F.when(holds(hi), F.col(self.value))).alias(f"_{name}_hi")]
            outs.append((F.col(f"_{name}_lo") + (at - lo) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name))
        return met.groupBy(*self.keys).agg(*aggs).select(*self.keys, *outs)

    def rows_with(self, groups: DataFrame) -> DataFrame:
        """``rows`` with further columns of each group; they travel with the summary, so rows don't meet on a group."""
        more = [c for c in groups.columns if c not in self.keys]
        told = self.summary.join(groups, self.keys) if self.keys else self.summary.crossJoin(F.broadcast(groups))  # one row without keys
        return self._placed(self._met(told), more)


def average_rank_pct(n_below: str = "n_below", n_eq: str = "n_eq", n_total: str = "n_total"):
    """Average-tie percentile rank in 0..100."""
    return (F.col(n_below) + (F.col(n_eq) + 1) / 2) / F.col(n_total) * 100


#: Bins a factor of e of the first count, and of each range that a later count divides.
BINS, SUBBINS = 185, 1024
#: Values of a range that are counted one by one.
EXACT = 20_000


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], exact: int = EXACT) -> DataFrame:
    """Exact linear-interpolation quantiles of each group, one row each, found by counting instead of sorting.

    A first count puts values into logarithmic bins; only the bins that hold a wanted position are divided further, until
    each holds one value or few enough to count one by one. Counts combine before each shuffle, so what travels grows
    with the bins of a group, not with its rows. ``df`` is read up to a handful of times and should be staged.
    """
    v, n, before = F.col("_v"), F.col("_n"), F.col("_before")
    cells = df.select(*keys, F.col(value).cast("double").alias("_v")).where(" and ".join(f"`{c}` is not null" for c in [*keys, "_v"]))
    size = F.least(F.greatest(F.log(F.abs(v)), F.lit(-800.0)), F.lit(800.0))  # infinities beyond all others
    first = F.when(F.isnan(v), 1_000_000).when(v == 0, 0).otherwise(F.signum(v).cast("long") * (F.floor(size * BINS) + 200_000))
    places = []
    for q in probs.values():
        at = (F.col("_total") - 1) * F.lit(float(q))
        places.append((at, F.floor(at), F.least(F.floor(at) + 1, F.col("_total") - 1)))
    holds = lambda k: (before <= k) & (before + n > k)
    wanted = F.lit(False)
    for _, lo, hi in places:
        wanted = wanted | holds(lo) | holds(hi)
    within = lambda by: Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = lambda by, order: F.sum("_n").over(within(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    tally = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    bins = cells.select("*", first.alias("_b")).groupBy(*keys, "_b").agg(*tally)
    bins = bins.select("*", upto(keys, "_b").alias("_before"), F.sum("_n").over(within(keys)).alias("_total"))
    points = []
    while True:
        held = stage(bins.where(wanted).select(*keys, "_lo", "_hi", "_n", "_before", "_total"), "quantile_bins")
        points.append(held.where("not _lo < _hi").select(*keys, F.col("_lo").alias("_v"), "_n", "_before", "_total"))
        ranges = held.where("_lo < _hi").select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), F.col("_before").alias("_base"), "_total", F.col("_n").alias("_size"))
        most = ranges.agg(F.max("_size")).first()[0]
        if most is None:
            break
        ranges = ranges.drop("_size")
        inside = (cells.join(ranges, keys) if keys else cells.crossJoin(ranges)).where((v >= F.col("_from")) & (v <= F.col("_to")))
        part = [*keys, "_base", "_total"]
        if most <= exact:
            each = inside.groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_n"))
            points.append(each.select(*keys, "_v", "_n", (F.col("_base") + upto(part, "_v")).alias("_before"), "_total"))
            break
        share = F.floor((v - F.col("_from")) / (F.col("_to") - F.col("_from")) * SUBBINS).alias("_b")
        bins = inside.select(*part, "_v", share).groupBy(*part, "_b").agg(*tally).select("*", (F.col("_base") + upto(part, "_b")).alias("_before"))
    found = points[0]
    for p in points[1:]:
        found = found.unionByName(p)
    aggs, outs = [F.max("_total").alias("_total")], []
    for name, (at, lo, hi) in zip(probs, places, strict=True):
        aggs += [F.max(F.when(holds(lo), v)).alias(f"_{name}_lo"), F.max(F.when(holds(hi), v)).alias(f"_{name}_hi")]
        outs.append((F.col(f"_{name}_lo") + (at - lo) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name))
    return found.groupBy(*keys).agg(*aggs).select(*keys, *outs)
