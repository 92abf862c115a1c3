"""Statistics: intervals, correlations, average ranks, resampling, signed ranks."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.clean import ratio

from .ranges import rejoined, running_sums


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = ratio(hits, n)
    centre = ratio(p + z * z / (2 * n), 1 + z * z / n)
    half = ratio(z * F.sqrt(ratio(p * (1 - p), n) + z * z / (4.0 * n * n)), 1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def pearson_of(x: str, y: str) -> Column:
    """Null for fewer than two rows or a constant column, where the built-in one raises."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    cov, va, vb = F.covar_pop(a, b), F.var_pop(a), F.var_pop(b)
    return F.when(F.count(a) >= 2, ratio(cov, F.nullif(F.sqrt(va * vb), F.lit(0.0))))


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1 with the mean of their places for ties; value is not null."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, by, value, ["_n"]).select(*by, value, (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(name))
    return rejoined(df, ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    rows = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, by, "_rx"), y, by, "_ry")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson_of("_rx", "_ry").alias("spearman"))


def signed_ranks(deltas: DataFrame, by: list[str], least: float = 1e-12) -> DataFrame:
    """W+, W-, and the rank-biserial effect (positive if the differences are below 0), with what ties add up to."""
    d = F.col("delta")
    counts = deltas.where(F.abs(d) > least).groupBy(*by, F.abs(d).alias("_a")).agg(F.count("*").alias("_n"), F.count_if(d > 0).alias("_up"), F.count_if(d < 0).alias("_down"))
    rank = F.col("before__n") + (F.col("_n") + 1) / 2.0
    rows = running_sums(counts, by, "_a", ["_n"])
    plus, minus, n = F.sum(rank * F.col("_up")), F.sum(rank * F.col("_down")), F.col("_n").cast("double")
    return rows.groupBy(*by).agg(F.sum("_n").alias("n_nonzero"), plus.alias("w_plus"), minus.alias("w_minus"), ratio(minus - plus, minus + plus).alias("effect"), F.sum(n * n * n - n).alias("ties"))


def wilcoxon_p(n: int, w: float, ties: float) -> tuple[str, float, float]:
    """Status and p-values (less, two-sided) of n differences with rank sum w above 0: exact without ties up to 50, else normal."""
    if not n:
        return "no_nonzero_deltas", math.nan, math.nan
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        below, above = ways[: int(w) + 1].sum() / 2.0**n, ways[int(w) :].sum() / 2.0**n
        return "ok", float(below), float(min(1.0, 2 * min(below, above)))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var)
    return "ok", 0.5 * math.erfc(-z / math.sqrt(2)), min(1.0, math.erfc(abs(z) / math.sqrt(2)))


#: The chance of a Poisson number of mean 1 to be at most k.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def resampled_means(deltas: DataFrame, by: str, key: str, iterations: int, seed: int) -> DataFrame:
    """by, means: the mean of each resample. A difference is in a resample a Poisson number of times, drawn from its
    key and the resample's number: tasks add up their own sums, wherever rows lie."""

    def run(batches):
        for pdf in batches:
            for group, rows in pdf.groupby("g", dropna=False):
                sums = np.zeros((2, iterations))
                for part in range(0, len(rows), 500):
                    d, k = (rows[c].to_numpy()[part : part + 500] for c in ("delta", "k"))
                    x = k.astype(np.uint64)[:, None] + np.arange(iterations, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
                    sums += np.stack([w.sum(axis=0), d.astype(float) @ w])
                yield pd.DataFrame({"g": [group], "sums": [np.stack(sums, axis=1).tolist()]})

    kind = dict(deltas.dtypes)[by]
    rows = deltas.select(F.col(by).alias("g"), F.col("delta").cast("double").alias("delta"), F.xxhash64(key, F.lit(seed)).alias("k"))
    cells = rows.mapInPandas(run, f"g {kind}, sums array<array<double>>").select("g", F.posexplode("sums").alias("i", "s"))
    each = cells.groupBy("g", "i").agg(F.sum(F.col("s")[0]).alias("w"), F.sum(F.col("s")[1]).alias("wd"))
    return each.groupBy(F.col("g").alias(by)).agg(F.collect_list(ratio("wd", F.nullif("w", F.lit(0.0)))).alias("means"))


#: Different rows of a group that one task resamples.
FEW_ROWS = 4096


def bootstrap_intervals(rows: DataFrame, by: list[str], streams: Mapping[str, tuple[str, int]], iterations: int = 1000, ends: tuple[float, float] = (0.025, 0.975), few_rows: int = FEW_ROWS) -> DataFrame:
    """by, and <name>_low and <name>_high of each stream: percentile intervals of the mean of a column.

    streams: name to (column, seed). Equal rows are counted first; a value that occurs n times is in a resample a
    Poisson number of times with mean n, drawn from the value, the stream's seed and the group. Tasks add up
    their own sums for all streams in one pass, so that of a group only `iterations` sums a stream are gathered.
    """
    values = list(dict.fromkeys(c for c, _ in streams.values()))
    counts = rows.where(F.concat(*(F.col(c).cast("string") for c in values)).isNotNull()).groupBy(*by, *values).agg(F.count("*").alias("_n"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    source = counts.select(key.alias("g"), "_n", *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)), F.xxhash64(*by, *values).alias("h"))
    packed = source.select(F.to_json("g", {"ignoreNullFields": "false"}).alias("j"), *source.columns)

    def sums_of(part: pd.DataFrame) -> list[np.ndarray]:
        out = []
        for column, seed in streams.values():
            v, total = part[f"v{values.index(column)}"].to_numpy(), np.zeros((2, iterations))
            for x, n, h in zip(v, part["_n"], part["h"], strict=True):
                w = np.random.Generator(np.random.Philox(key=[h & (2**64 - 1), seed])).poisson(n, iterations)
                total[0] += w
                total[1] += w * x
            out.append(total)
        return out

    def run(batches):
        for pdf in batches:
            for j, part in pdf.groupby("j", sort=False):
                yield pd.DataFrame({"j": [j], "sums": [[t.T.tolist() for t in sums_of(part)]]})

    def whole(j: str, sums: list[np.ndarray]) -> tuple:
        means = [t[1][t[0] > 0] / t[0][t[0] > 0] for t in sums]
        return j, *(np.quantile(m, ends).tolist() if len(m) else None for m in means)

    def run_whole(batches):
        last, sums = None, []
        for pdf in batches:
            done = []
            for j, part in pdf.groupby("j", sort=False):
                more = sums_of(part)
                if j == last:
                    sums = [a + b for a, b in zip(sums, more, strict=True)]
                    continue
                if last is not None:
                    done.append(whole(last, sums))
                last, sums = j, more
            yield pd.DataFrame(done, columns=["j", *streams])
        if last is not None:
            yield pd.DataFrame([whole(last, sums)], columns=["j", *streams])

    # a group of few rows is smaller than its sums: its rows are gathered in one task, and only its ends leave it; tasks
    # are counted, as their size in bytes doesn't tell their work
    sizes = packed.groupBy("j").agg(F.count("*").alias("_rows"))
    sized = packed.drop("g").join(sizes, "j")
    few = sized.where(F.col("_rows") <= few_rows).drop("_rows").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "j").sortWithinPartitions("j")
    gathered = few.mapInPandas(run_whole, "j string, " + ", ".join(f"`{n}` array<double>" for n in streams))
    cells = sized.where(F.col("_rows") > few_rows).drop("_rows").mapInPandas(run, "j string, sums array<array<array<double>>>")
    cells = cells.select("j", F.posexplode("sums").alias("stream", "sums")).select("j", "stream", F.posexplode("sums").alias("i", "s"))
    means = cells.groupBy("j", "stream", "i").agg(F.sum(F.col("s")[0]).alias("w"), F.sum(F.col("s")[1]).alias("x")).withColumn("m", ratio("x", F.nullif("w", F.lit(0.0))))
    of = lambda k: F.percentile(F.when(F.col("stream") == k, F.col("m")), F.array(*map(F.lit, ends)))
    found = means.groupBy("j").agg(*(of(k).alias(n) for k, n in enumerate(streams))).unionByName(gathered)
    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) or "_all int"
    found = found.select(F.from_json("j", kind).alias("g"), *streams)
    return found.select(*(F.col("g")[c].alias(c) for c in by), *(F.col(n)[i].alias(f"{n}_{e}") for n in streams for i, e in enumerate(("low", "high"))))


def resampled_medians(deltas: DataFrame, by: str, iterations: int, seed: int) -> DataFrame:
    """by, medians: the median of each resample. Its place among the sorted differences is an order statistic of n uniform
    numbers, so that n tells the places, and the differences at those places are all that is gathered of a group."""
    counts = deltas.groupBy(by, "delta").agg(F.count("*").alias("_n"))
    placed = running_sums(counts, [by], "delta", ["_n"])

    def draw(batches):
        for pdf in batches:
            lists = []
            for n in pdf["n"]:
                rng = np.random.default_rng([seed, int(n)])
                j = (int(n) + 1) // 2
                u = rng.beta(j, n - j + 1, iterations)
                v = u if n % 2 else u + (1 - u) * (1 - rng.random(iterations) ** (1 / (n - j)))
                lists.append(np.minimum(np.floor(np.stack([u, v], axis=1) * n), n - 1).astype(int).tolist())
            yield pdf.assign(places=lists)

    kind = dict(deltas.dtypes)[by]
    places = deltas.groupBy(by).agg(F.count("*").alias("n")).mapInPandas(draw, f"`{by}` {kind}, n bigint, places array<array<bigint>>")
    lo, hi = (f(F.flatten("places")) for f in (F.array_min, F.array_max))
    near = rejoined(placed, places.select(by, F.array_distinct(F.flatten("places")).alias("_places"), lo.alias("_lo"), hi.alias("_hi")), [by])
    near = near.where((F.col("before__n") <= F.col("_hi")) & (F.col("before__n") + F.col("_n") > F.col("_lo")))
    held = F.filter("_places", lambda p: (p >= F.col("before__n")) & (p < F.col("before__n") + F.col("_n")))
    table = near.select(by, "delta", F.explode(held).alias("place")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("place", "delta"))).alias("at"))
    both = rejoined(places.select(by, "places"), table, [by])
    return both.select(by, F.transform("places", lambda p: (F.element_at("at", p[0]) + F.element_at("at", p[1])) / 2).alias("medians"))


def paired_tests(deltas: DataFrame, by: str, order: str, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Signed-rank p-values and percentile bootstrap intervals of mean and median of each group of differences.

    order: what tells a group's rows apart. No group is gathered: the statistics are aggregates, the resamples of
    means are summed by tasks, and of those of medians only the places drawn are looked up.
    """
    d = deltas.where(F.col("delta").isNotNull() & ~F.isnan("delta") & (F.abs("delta") < float("inf"))).select(by, order, F.col("delta").cast("double").alias("delta"))
    n = d.groupBy(by).agg(F.count("*").alias("n"))
    rows = rejoined(rejoined(n, signed_ranks(d, [by]), [by], "left"), resampled_means(d, by, order, iterations, seed), [by], "left")
    rows = rejoined(rows, resampled_medians(d, by, iterations, seed), [by], "left").select(by, "n", F.coalesce("n_nonzero", F.lit(0)).alias("m"), F.coalesce("w_plus", F.lit(0.0)).alias("w"), F.coalesce("ties", F.lit(0.0)).alias("t"), "means", "medians")

    def run(batches):
        for pdf in batches:
            out = []
            for g, n, m, w, t, means, medians in pdf.itertuples(index=False):
                ends = [float(np.nanpercentile(np.asarray(x, dtype=float), q)) for x in (means, medians) for q in (2.5, 97.5)]
                out.append([g, n, *wilcoxon_p(int(m), w, t), *ends])
            yield pd.DataFrame(out, columns=["k", "n", "status", "p_less", "p_two", "mean_low", "mean_high", "median_low", "median_high"])

    out = rows.mapInPandas(run, f"k {dict(deltas.dtypes)[by]}, n bigint, status string, p_less double, p_two double, mean_low double, mean_high double, median_low double, median_high double")
    return out.withColumnRenamed("k", by)


def indicator_interval(rows: DataFrame, by: list[str], hit: str, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """by, n, rate, low, high: percentile bootstrap of a rate. The hits of a resample are a binomial number, so counts are enough."""
    counts = rows.where(F.col(hit).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("_hits"))

    def run(batches):
        for pdf in batches:
            draws = [np.random.default_rng([seed, int(n), int(h)]).binomial(n, h / n, iterations) / n for n, h in zip(pdf["n"], pdf["_hits"], strict=True)]
            ends = [[float(np.percentile(x, q)) for x in draws] for q in (2.5, 97.5)]
            yield pdf.assign(rate=pdf["_hits"] / pdf["n"], low=ends[0], high=ends[1]).drop(columns="_hits")

    return counts.mapInPandas(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "n bigint, rate double, low double, high double"]))
