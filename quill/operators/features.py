"""Feature engineering. Level lists and cut points are the
only values brought to the driver; they are bounded by cardinality, not rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import split_tags
from ..session import cut_lineage
from .common import measured_broadcast


def merge_tags(arr: Column, mapping: dict[str, str]) -> Column:
    """Replace array elements by their synonym."""
    if not mapping:
        return arr
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(arr, lambda x: F.coalesce(F.try_element_at(m, x), x))


def assign_topic(df: DataFrame, tags_col: str, topics: list[str], synonyms: dict | None = None,
                 out: str = "Topics", sep: str = ",") -> DataFrame:
    """the first of the row's tags (row order) that is in the topic list,
    after merging synonyms; NULL if none."""
    tags = merge_tags(split_tags(F.col(tags_col), sep), synonyms or {})
    hit = F.array_intersect(tags, F.array(*[F.lit(t) for t in topics]))
    return df.withColumn(out, F.get(hit, 0))


def frequency_band(df: DataFrame, col: str, labels=("Q1", "Q2", "Q3", "Q4"),
                   out: str = "band", null_label: str | None = "Q1") -> DataFrame:
    """frequency of each value cut at the quartiles of those frequencies,
    right-closed with the lowest included; equal cuts: the first band wins.
    Rows with a NULL value get ``null_label``."""
    f = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_f"))
    k = len(labels)
    probs = [i / k for i in range(1, k)]
    # the k-1 cut points are brought to the driver as literals
    cuts = f.agg(F.percentile(F.col("_f").cast("double"), probs).alias("_q")).collect()[0]["_q"] or []
    band = None
    for lab, cut in zip(labels[:-1], cuts):
        cond = F.col("_f") <= F.lit(float(cut))
        band = F.when(cond, F.lit(lab)) if band is None else band.when(cond, F.lit(lab))
    band = band.otherwise(F.lit(labels[-1])) if band is not None else F.lit(labels[-1])
    bands = f.select(col, band.alias(out))
    res = df.join(measured_broadcast(bands), on=col, how="left")
    if null_label is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(null_label)))
    return res


def collapse_rare(df: DataFrame, col: str, min_count: int = 30) -> DataFrame:
    """levels seen in fewer than ``min_count`` rows become NULL.
    Frequencies come from a partial aggregate joined back (no window over a
    possibly hot level)."""
    f = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_count).select(
        F.col(col).alias("_rare"))
    out = df.join(measured_broadcast(f), F.col(col) == F.col("_rare"), "left")
    return out.withColumn(col, F.when(F.col("_rare").isNull(), F.col(col))).drop("_rare")


def na_to_other(df: DataFrame, cols, label: str = "Other") -> DataFrame:
    """NULL level → ``Other`` (real NULLs, §2.17 #14)."""
    return df.fillna(label, subset=list(cols))


#: levels of one column that may come to the driver
MAX_LEVELS = 10_000


def levels(df: DataFrame, cols, max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Distinct non-NULL levels per column, alphabetical. They are counted
    before they are collected; a column with more than ``max_levels`` raises."""
    cols = list(cols)
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                                         for c in cols]))).where("level IS NOT NULL").distinct()
    pairs = cut_lineage(pairs)
    for r in pairs.groupBy("column").count().where(F.col("count") > max_levels).collect():
        raise ValueError(f"{r['column']} has {r['count']} levels, more than max_levels={max_levels}")
    out: dict[str, list] = {c: [] for c in cols}
    for r in pairs.collect():
        out[r["column"]].append(r["level"])
    return {c: sorted(v, key=lambda x: x.encode()) for c, v in out.items()}


def dummies(df: DataFrame, cols, drop_first: bool = False, sep: str = "_",
            level_map: dict | None = None, keep_original: bool = False) -> DataFrame:
    """one-hot columns ``{col}{sep}{level}`` (int 0/1, NULL stays NULL);
    all levels, or the alphabetically first dropped. Level lists are collected
    once (bounded by cardinality); the columns are then one ``select``."""
    cols = list(cols)
    lv = level_map or levels(df, cols)
    new = []
    for c in cols:
        ls = lv[c][1:] if drop_first else lv[c]
        for v in ls:
            new.append(F.when(F.col(c).isNull(), F.lit(None)).otherwise(
                (F.col(c).cast("string") == F.lit(v)).cast("int")).alias(f"{c}{sep}{v}"))
    base = [F.col(x) for x in df.columns if keep_original or x not in cols]
    return df.select(*base, *new)


def scale(df: DataFrame, cols, population: bool = False, stats: dict | None = None,
          suffix: str = "") -> DataFrame:
    """F7 (sample sd) / F8 (population sd, constant column divided by 1)."""
    cols = list(cols)
    st = stats or fit_scaler(df, cols, population)
    return df.select(*[c for c in df.columns if suffix or c not in cols],
                     *[((F.col(c) - F.lit(st[c][0])) / F.lit(st[c][1])).alias(f"{c}{suffix}") for c in cols])


def fit_scaler(df: DataFrame, cols, population: bool = True) -> dict[str, tuple[float, float]]:
    """F8 fit: mean and sd per column in one pass (train side only)."""
    sd = F.stddev_pop if population else F.stddev_samp
    r = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__m"), sd(c).alias(f"{c}__s"))]).collect()[0]
    out = {}
    for c in cols:
        s = r[f"{c}__s"]
        out[c] = (float(r[f"{c}__m"]), float(s) if s else 1.0)
    return out


def split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42,
          col: str = "is_test") -> DataFrame:
    """exact seeded split: of all rows in the order of md5(seed ‖ key) the first
    ceil(test_frac·n) are the test set. Independent of partitioning (unlike
    ``randomSplit``).

    The last hash of the test set is found by counting hashes by their first 16
    bits, then the next 16 bits of those in the range that holds it, until few
    enough are left to be looked at; a comparison with it is all that the rows see,
    they are neither sorted nor shuffled. Rows of equal key have equal hashes and
    stay together, on the side of the first of them; NULL keys come first."""
    h = F.coalesce(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), F.lit(""))
    last = last_of_first(df.select(h.alias("h")), test_frac)
    return df.withColumn(col, F.lit(False) if last is None else h <= F.lit(last))


#: hashes that the driver looks at, at most
FEW = 50_000


def last_of_first(hashes: DataFrame, share: float) -> str | None:
    """The ceil(share·n)-th smallest of n hexadecimal texts ``h``; None for none."""
    prefix, left = "", None
    while True:
        step = len(prefix) + 4
        got = sorted((r.p, r["n"]) for r in hashes.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, step).alias("p"))
                     .agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,537 rows
        if left is None:
            n = sum(c for _, c in got)
            left = -(-int(round(share * n * 1e9)) // int(1e9))  # ceil without float noise
            if left <= 0:
                return None
        for p, c in got:
            if left <= c:
                break
            left -= c
        if len(p) < step or step >= 32:  # a whole hash
            return p
        if c <= FEW:
            return sorted(r.h for r in hashes.where(F.col("h").startswith(p)).collect())[left - 1]
        prefix = p


#: distinct values that one range of ``exact_quantiles`` should hold
RANGE_VALUES = 500_000


def exact_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """Type-7 quantiles for many columns: (column, prob, value)."""
    cols = list(cols)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(c).cast("double").alias("x")) for c in cols])))
    return quantiles_by(long, ["column"], "x", probs)


def quantiles_by(df: DataFrame, group_cols, value_col: str, probs) -> DataFrame:
    """Type-7 quantiles of a value per group: (groups, prob, value).

    Rows are first counted per (group, value), combined before the shuffle, so
    a value that a third of all rows share is one row. The distinct values are
    sorted over ranges; the ranges' sums tell which of them hold the order
    statistics around each (n−1)·p, and only these are counted through.
    """
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    vals = cut_lineage(df.where(x.isNotNull()).groupBy(*g, x.alias("_x")).agg(F.count(F.lit(1)).alias("_k")))
    ranges = max(1, -(-vals.count() // RANGE_VALUES))
    cut = cut_lineage(vals.repartitionByRange(ranges, *g, "_x").withColumn("_r", F.spark_partition_id()))
    sums = cut.groupBy(*g, "_r").agg(F.sum("_k").alias("_k"))
    before = Window.partitionBy(*g).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    sums = sums.select(*g, "_r", "_k", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"),
                       F.sum("_k").over(whole).alias("_n"))
    h = (F.col("_n") - 1) * F.col("prob")
    want = sums.select(*g, "_r", "_k", "_before", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    lo = F.floor(h).cast("long")
    want = want.select(*g, "_r", "_k", "_before", "prob", (h - lo).alias("_part"), F.explode(F.array_distinct(F.array(
        lo, F.least(lo + 1, F.col("_n") - 1)))).alias("_at"), lo.alias("_lo"))
    # (range, group, position) of the wanted order statistics: at most two per group and probability
    want = want.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_k"))) \
        .select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_r").alias("_gr"), "_before", "prob", "_part", "_at", "_lo")
    same = F.col("_r") == F.col("_gr")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    want = measured_broadcast(want)
    run = Window.partitionBy("_r", *g).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    through = cut.join(want, same, "left_semi").withColumn("_from", F.coalesce(F.sum("_k").over(run), F.lit(0)))
    hit = through.join(want, same & (F.col("_at") >= F.col("_before") + F.col("_from"))
                       & (F.col("_at") < F.col("_before") + F.col("_from") + F.col("_k")))
    low = F.max(F.when(F.col("_at") == F.col("_lo"), F.col("_x")))
    high = F.coalesce(F.max(F.when(F.col("_at") != F.col("_lo"), F.col("_x"))), low)
    return hit.groupBy(*g, "prob").agg((low + F.max("_part") * (high - low)).alias("value"))


def _label_digits(cuts: list[float]) -> int | None:
    """Decimal places that keep the labels of distinct cuts distinct: 4, or as
    many more as it takes; None: unrounded."""
    return next((d for d in range(4, 16) if len({round(c, d) for c in cuts}) == len(cuts)), None)


def _fmt(v: float, digits: int | None) -> Column:
    return (F.lit(v) if digits is None else F.round(F.lit(v), digits)).cast("string")


def discretize(df: DataFrame, cols, bins: int = 3, keep_original: bool = False) -> DataFrame:
    """equal-frequency bins (arules ``discretize`` default): cuts at the
    type-7 quantiles 0, 1/b, …, 1; equal cuts merged; intervals ``[lo,hi)``
    with the last closed ``[lo,hi]``. Labels use the cut values rounded to 4
    places, or to more where that would merge two cuts."""
    cols = list(cols)
    probs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(df, cols, probs).collect()
    cuts: dict[str, list[float]] = {c: [] for c in cols}
    for r in sorted(q, key=lambda r: (r["column"], r["prob"])):
        if not cuts[r["column"]] or cuts[r["column"]][-1] != r["value"]:
            cuts[r["column"]].append(r["value"])
    out = []
    for c in cols:
        cs = cuts[c]
        x = F.col(c).cast("double")
        if len(cs) < 2:
            # no value, or one value only
            e = F.when(x.isNotNull(), F.concat(F.lit("["), _fmt(cs[0], 4), F.lit(","), _fmt(cs[0], 4), F.lit("]"))) \
                if cs else F.lit(None).cast("string")
        else:
            e, digits = None, _label_digits(cs)
            for i in range(len(cs) - 1):
                last = i == len(cs) - 2
                cond = (x <= cs[i + 1]) if last else (x < cs[i + 1])  # not in the bins before; none is below the least cut
                lab = F.concat(F.lit("["), _fmt(cs[i], digits), F.lit(","), _fmt(cs[i + 1], digits),
                               F.lit("]" if last else ")"))
                e = F.when(cond, lab) if e is None else e.when(cond, lab)
        out.append(e.alias(c))
    base = [F.col(x) for x in df.columns if x not in cols]
    if keep_original:
        base = [F.col(x) for x in df.columns]
        out = [o.alias(f"{c}_bin") for o, c in zip(out, cols)]
    return df.select(*base, *out)


def to_items(df: DataFrame, cols, out: str = "items") -> DataFrame:
    """one transaction per row, items ``column=level``; NULLs give no item."""
    arr = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols])  # NULL of a NULL
    return df.withColumn(out, F.filter(arr, lambda x: x.isNotNull()))
