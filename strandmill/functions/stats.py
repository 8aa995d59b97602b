"""Statistics: column expressions where one row suffices, small frames where a distribution is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranking import running

ZETA2 = 1.644934  # fixed value: the limit of the sum of 1 / i^2, as published with the score


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """``struct(low, high)`` of a proportion's interval, six digits; nulls for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = hits / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.struct(F.round(centre - half, 6).alias("low"), F.round(centre + half, 6).alias("high"))


def saturating(n: Column, full: int = 3) -> Column:
    """Evidence of n independent records, full at ``full``."""
    return F.least(F.lit(1.0), n / F.lit(full))


def harmonic_score(*counts: Column, full: int = 3) -> Column:
    """Evidence of several sources: their saturating terms in descending order, weighted 1 / i^2, over zeta(2); six digits."""
    terms = F.sort_array(F.array(*[saturating(c, full) for c in counts]), asc=False)
    summed = F.aggregate(F.transform(terms, lambda x, i: x / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x)
    return F.round(summed / ZETA2, 6)


def wilcoxon(differences: DataFrame, d: str = "d") -> DataFrame:
    """One row of the paired signed-rank test by its normal approximation: n, w_plus, w_minus, tie, z, two-sided p, r.

    Zeros and nulls are dropped; ties get middle ranks. The ranks come from a histogram of |d| and its running sum,
    which many tasks make. No difference at all, or no variance, gives z = 0, p = 1 and r = 0. Cubes of ties are summed
    as decimals, as two million equal differences leave the range of a long integer; ``tie`` is a long and is refused
    beyond it, where it is asked for.
    """
    h = differences.where(F.col(d).isNotNull() & (F.col(d) != 0)).groupBy(F.abs(d).alias("a")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(d) > 0).cast("long")).alias("up"))
    ranked = running(h, [], [F.col("a").asc()], F.col("t"), "below").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    wide = F.col("t").cast("decimal(19,0)")
    cubed = (wide * wide * wide).cast("decimal(38,0)")
    s = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("t") - F.col("up"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(cubed - F.col("t")), F.lit(0)).alias("tie"),
    )
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie").cast("double") / 48
    dev = F.col("w_plus") - total / 2
    sign = F.when(dev < 0, -1.0).otherwise(1.0)
    z = F.when((n > 0) & (var > 0), (dev - sign * 0.5) / F.sqrt(var)).otherwise(0.0)
    r = F.when((n > 0) & (var > 0), (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0)
    s = s.withColumn("z", z).withColumn("r", r)
    return s.select("n", "w_plus", "w_minus", F.col("tie").cast("bigint").alias("tie"), F.round("z", 6).alias("z"), F.round(F.when(F.col("n") > 0, two_sided(F.col("z"))).otherwise(1.0), 9).alias("p"), F.round("r", 6).alias("r"))


def empirical_p(null: Column, observed: Column) -> Column:
    """(number of null values at or below the observed one + 1) / (n + 1), as an aggregate."""
    return (F.sum((null <= observed).cast("long")) + 1) / (F.count(null) + 1)


def overlap_coefficient(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row ``ovl``: the shared mass of two histograms of ``value``; null if one is empty."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("v", (F.col("n") / F.col("all")).alias(name))

    both = shares(a, "pa").join(shares(b, "pb"), "v", "full")
    return both.agg(F.when((F.count("pa") > 0) & (F.count("pb") > 0), F.round(F.sum(F.least(F.coalesce("pa", F.lit(0.0)), F.coalesce("pb", F.lit(0.0)))), 6)).alias("ovl"))


def paired_stats(pairs: DataFrame, x: str, y: str, computable: tuple[str, str] | None = None) -> DataFrame:
    """Means, mean and median difference, and ratio of population variances of two columns of one frame; six digits.

    ``computable`` names the numbers of votes (of two) that could be computed on either side; their means over two and
    the ratio of those are added. Without variance or anything computable on the first side the ratio is 0.
    """
    d = F.col(x) - F.col(y)
    extra = []
    if computable:
        a, b = F.avg(computable[0]) / 2, F.avg(computable[1]) / 2
        extra = [F.round(a, 6).alias("computable_x"), F.round(b, 6).alias("computable_y"), F.round(F.when(a > 0, b / a).otherwise(0.0), 6).alias("computable_ratio")]
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_x"), F.round(F.avg(y), 6).alias("mean_y"), F.round(F.avg(d), 6).alias("mean_diff"),
        F.round(F.median(d), 6).alias("median_diff"), F.round(F.when(F.var_pop(x) > 0, F.var_pop(y) / F.var_pop(x)).otherwise(0.0), 6).alias("variance_ratio"), *extra,
    )


def two_sided(z: Column) -> Column:
    """erfc(|z| / sqrt 2) by its Taylor series for small and by its continued fraction for large arguments; relative error below 1e-9."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    # erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum over n of 2^n x^(2n+1) / (1 * 3 * ... * (2n+1))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), lambda s, n: F.struct((s["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("sum")))["sum"]
    small = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    # erfc(x) = exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + (2/2) / (x + (3/2) / (x + ...))))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda f, n: x + n / 2 / f)
    return F.when(x < 2.5, small).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def discriminator(mean_diff: Column, p: Column, computable_ratio: Column, variance_ratio: Column) -> Column:
    """What a comparison without a difference means: not_applicable if there is a significant one, weak_ruler where the null's computable share falls below 0.70 or its variance below 0.50 of the real one's, else no_path_information."""
    # fixed values: the significance level and both thresholds
    significant = F.coalesce(p < 0.05, F.lit(False))
    weak = (computable_ratio < 0.70) | (variance_ratio < 0.50)
    return F.when(significant & (mean_diff > 0), "not_applicable").when(significant, "not_applicable_reversed").when(weak, "weak_ruler").otherwise("no_path_information")
