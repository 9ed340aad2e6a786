"""Aggregations. Each is one or two passes; every global
aggregate is partial+final (map-side combine), so hot keys are reduced before
the shuffle."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_broadcast


def _long_form(row_df: DataFrame, names: list[str], value_names: list[str], var: str = "column"):
    """Turn a one-row aggregate of ``len(names)`` groups of values into one row per name."""
    structs = [F.struct(F.lit(n).alias(var), *[F.col(f"{n}__{v}").alias(v) for v in value_names])
               for n in names]
    return row_df.select(F.inline(F.array(*structs)))


def null_counts(df: DataFrame, cols=None, total: bool = True) -> DataFrame:
    """G1: NULL count per column and a ``__total__`` row, all from one scan."""
    cols = list(cols or df.columns)
    counts = [F.count_if(F.col(c).isNull()).cast("long") for c in cols]
    aggs = [e.alias(f"{c}__n_null") for c, e in zip(cols, counts)]
    names = list(cols)
    if total:
        tot = counts[0]
        for e in counts[1:]:
            tot = tot + e
        aggs.append(tot.alias("__total____n_null"))
        names.append("__total__")
    return _long_form(df.agg(*aggs), names, ["n_null"])


def zero_counts(df: DataFrame, cols) -> DataFrame:
    """Rows equal to 0 per column (one scan)."""
    cols = list(cols)
    r = df.agg(*[F.count_if(F.col(c) == 0).cast("long").alias(f"{c}__n_zero") for c in cols])
    return _long_form(r, cols, ["n_zero"])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column (NULL included as a value)."""
    return df.select(col).distinct()


def n_distinct(df: DataFrame, col: str, count_null: bool = True, name: str = "n_distinct") -> DataFrame:
    """R ``length(unique(x))`` counts NA as a value; ``count_null=False``
    gives SQL ``count(distinct)``."""
    e = F.count_distinct(F.col(col))
    if count_null:
        e = e + F.max(F.col(col).isNull().cast("int"))
    return df.agg(e.cast("long").alias(name))


def freq(df: DataFrame, col: str, sort: str | None = None, drop_null: bool = True,
         name: str = "n") -> DataFrame:
    """Frequency table (R ``table`` drops NA). ``sort``: 'asc'|'desc'|None."""
    d = df.where(F.col(col).isNotNull()) if drop_null else df
    out = d.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if sort == "desc":
        out = out.orderBy(F.desc(name), F.asc(col))
    elif sort == "asc":
        out = out.orderBy(F.asc(name), F.asc(col))
    return out


def top_k(df: DataFrame, col: str, k: int, name: str = "n") -> DataFrame:
    """K most frequent values, ties by value (TakeOrdered, bounded by k)."""
    return freq(df, col, name=name).orderBy(F.desc(name), F.asc(col)).limit(k)


def group_sum(df: DataFrame, keys, value: str, name: str = "total") -> DataFrame:
    """Group-by sum."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def pivot_fill(df: DataFrame, key, name_col: str, value_col: str, values: list,
               fill=0, suffix: str = "", agg: str = "sum") -> DataFrame:
    """Pivot wider with the level list given (one pass, no distinct job),
    missing cells filled, names suffixed."""
    keys = [key] if isinstance(key, str) else list(key)
    fn = getattr(F, agg)
    out = df.groupBy(*keys).pivot(name_col, values).agg(fn(value_col))
    out = out.na.fill(fill, subset=[str(v) for v in values])
    return out.select(*keys, *[F.col(f"`{v}`").alias(f"{v}{suffix}") for v in values])


def shares(df: DataFrame, cols) -> DataFrame:
    """Each column's share of the grand total of a column block."""
    cols = list(cols)
    r = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"{c}__total") for c in cols])
    long = _long_form(r, cols, ["total"])
    # the long table has one row per column, so a global window is tiny here
    return long.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def ranges(df: DataFrame, cols) -> DataFrame:
    """Min and max per column (one scan)."""
    cols = list(cols)
    r = df.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"{c}__min"),
                                            F.max(c).cast("double").alias(f"{c}__max"))])
    return _long_form(r, cols, ["min", "max"])


def mean_var(df: DataFrame, col: str) -> DataFrame:
    """Mean and sample variance."""
    return df.agg(F.avg(col).alias("mean"), F.var_samp(col).alias("variance"))


def freq_quantiles(df: DataFrame, col: str, probs=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Quantiles (type 7, interpolated) of the per-value frequencies.
    ``percentile`` keeps a map value→count, so its buffer is bounded by the
    number of distinct frequencies, not by rows."""
    f = freq(df, col)
    return f.agg(F.percentile(F.col("n").cast("double"), list(probs)).alias("q")).select(
        F.posexplode("q").alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("prob"), "value")


def sum_by_base(freq_df: DataFrame, item_col: str, count_col: str, name: str = "n") -> DataFrame:
    """Re-key ``column=level`` items by ``column`` and sum their counts."""
    return freq_df.groupBy(F.regexp_replace(F.col(item_col), "=.*$", "").alias("variable")).agg(
        F.sum(count_col).cast("long").alias(name))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form (no driver-side crosstab)."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))


#: as in R's ``hist``, a value this many bin widths past a break still counts
#: as lying on it, so 0.07 is in (0.065, 0.07] whatever its binary neighbours
FUZZ = 1e-7


def _bin_index(x: Column, start, width) -> Column:
    """Right-closed bin number (1-based), lowest edge in bin 1."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    i = F.ceil((x - lit(start)) / lit(width) - F.lit(FUZZ))
    return F.greatest(i, F.lit(1)).cast("long")


def histogram(df: DataFrame, col: str, start: float, stop: float, width: float) -> DataFrame:
    """Fixed breaks ``start, start+width, …, stop``; bins ``(lo, hi]`` with
    the lowest edge included; empty bins are listed with 0. Values outside the
    breaks are kept in a row with NULL edges (R would refuse the call)."""
    nb = int(round((stop - start) / width))
    x = F.col(col).cast("double")
    inside = (x >= start - FUZZ * width) & (x <= stop + FUZZ * width)
    counts = df.where(x.isNotNull()).groupBy(
        F.when(inside, _bin_index(x, start, width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    bins = spark.range(1, nb + 1).select(F.col("id").alias("bin"))
    # bounded by the number of bins (a parameter), not by rows
    full = bins.join(F.broadcast(counts.where(F.col("bin").isNotNull())), "bin", "left")
    full = full.select("bin", (F.lit(start) + (F.col("bin") - 1) * width).alias("lo"),
                       (F.lit(start) + F.col("bin") * width).alias("hi"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    outside = counts.where(F.col("bin").isNull()).select(
        "bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.col("n").cast("long"))
    return full.unionByName(outside)


def pretty_breaks(lo: float, hi: float, n: int = 5, spec: bool = False):
    """About ``n`` equal intervals that cover [lo, hi], their width 1, 2 or 5
    times a power of ten (R's ``pretty`` as its help page describes it).

    Of these widths the largest is taken that the wanted width (hi - lo) / n
    nears from below by a bias: a width is passed over while the next one is
    closer, distances from above counting 1.5 times (2.75 for 5s). A range
    without extent gets the width that suits its magnitude. At least n // 3
    intervals come out. With ``spec``: (first break, width, intervals)."""
    least = n // 3
    extent, size = hi - lo, max(abs(lo), abs(hi))
    if size == 0:
        want = 1.0 / max(least, 1)
    elif extent < size * n * 1e-15:
        want = (size if size <= 10 else 9 + size / 10) / max(least, 1)
    else:
        want = extent / n
    ten = 10.0 ** math.floor(math.log10(want))
    unit = ten
    for wider, bias in ((2 * ten, 1.5), (5 * ten, 2.75), (10 * ten, 1.5)):
        if wider - want >= bias * (want - unit):
            break
        unit = wider
    first, last = math.floor(lo / unit + FUZZ), math.ceil(hi / unit - FUZZ)
    missing = least - (last - first)
    if missing > 0:
        up = missing // 2 if first >= 0 else missing - missing // 2
        first, last = first - (missing - up), last + up
    if spec:
        return first * unit, unit, int(last - first)
    return [first * unit + i * unit for i in range(int(last - first) + 1)]


def sturges_bins(n: int) -> int:
    """R ``nclass.Sturges``: ceil(log2(n) + 1)."""
    return int(math.ceil(math.log2(n) + 1)) if n > 0 else 1


def histograms(df: DataFrame, cols) -> DataFrame:
    """R ``hist`` default bins (Sturges count, ``pretty`` breaks) for many
    columns: one stats pass over all columns, then one binned group-by over the
    unpivoted values. Output (column, bin, lo, hi, n), empty bins with 0."""
    cols = list(cols)
    r = df.agg(*[e for c in cols for e in (
        F.min(F.col(c).cast("double")).alias(f"{c}__min"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        F.count(c).alias(f"{c}__n"))]).collect()[0]
    spec = []
    for c in cols:
        if r[f"{c}__n"] == 0:
            continue
        start, unit, nb = pretty_breaks(r[f"{c}__min"], r[f"{c}__max"], sturges_bins(r[f"{c}__n"]), spec=True)
        spec.append((c, float(start), float(unit), nb))
    spark = df.sparkSession
    spec_df = spark.createDataFrame(spec, "column string, start double, width double, nbins int")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(c).cast("double").alias("x")) for c in cols])))
    # one row per column (schema-bounded)
    long = long.where(F.col("x").isNotNull()).join(F.broadcast(spec_df), "column")
    binned = long.groupBy("column", _bin_index(F.col("x"), F.col("start"), F.col("width")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = spec_df.select("column", "start", "width",
                          F.explode(F.sequence(F.lit(1), F.col("nbins"))).alias("bin"))
    out = grid.withColumn("bin", F.col("bin").cast("long")).join(binned, ["column", "bin"], "left")
    return out.select("column", "bin", (F.col("start") + (F.col("bin") - 1) * F.col("width")).alias("lo"),
                      (F.col("start") + F.col("bin") * F.col("width")).alias("hi"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scatter(df: DataFrame, x: str, y: str, key: str, max_points: int | None = None,
            seed: int = 42) -> DataFrame:
    """The (x, y) pairs behind a scatter plot; with ``max_points`` a
    deterministic hash sample (same answer under any partitioning)."""
    out = df.select(key, x, y)
    if max_points is None:
        return out
    h = F.xxhash64(F.col(key), F.lit(seed))
    return out.orderBy(h, F.col(key)).limit(max_points)
