"""Evaluation of scored rows: a probability column ``p`` and a 0/1 label column ``y``.

Most metrics depend only on the numbers of positives and negatives at each score. They also
take a table (p, pos, neg) of such counts, so that several metrics can share one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotspark.scale import exact_quantiles, materialize, prefix_sums, quantiles_of_ranks

TOP = 1e-8  # widens the last bin, so that 1.0 falls into it


# --- checks -----------------------------------------------------------------------------


def scored_summary(df: DataFrame) -> DataFrame:
    """One row: size, range of p, smallest and largest label, whether another label occurs."""
    low, high = F.min("y"), F.max("y")
    return df.agg(
        F.count("*").alias("n"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
        F.count_if(F.col("p").isNull() | F.isnan("p")).alias("n_missing"),
        F.count_if(F.col("y").isNull()).alias("n_unlabelled"),
        low.alias("y_min"),
        high.alias("y_max"),
        F.count_distinct("y").alias("n_labels"),
    )


def check_scored(df: DataFrame, both_labels: bool = False) -> None:
    """Raise unless p lies in [0, 1] and y has at most two values (exactly two on demand)."""
    s = scored_summary(df).first()
    if s["n"] and s["n_missing"]:
        raise ValueError("p has missing values")
    if s["n"] and s["n_unlabelled"]:
        raise ValueError("y has missing values")
    if s["n"] and (s["p_min"] < 0 or s["p_max"] > 1):
        raise ValueError("p has values outside [0, 1]")
    if s["n_labels"] > 2 or (both_labels and s["n_labels"] != 2):
        raise ValueError("only binary classification is supported")


# --- binned calibration -----------------------------------------------------------------


def _checked(df: DataFrame) -> DataFrame:
    """Scored rows are checked; tables of counts come from rows that were."""
    if "pos" not in df.columns:
        check_scored(df)
    return df


def uniform_edges(n_bins: int) -> list[float]:
    step = (1.0 + TOP) / n_bins
    return [i * step for i in range(n_bins)] + [1.0 + TOP]


def quantile_edges(df: DataFrame, n_bins: int) -> list[float]:
    return _closed(exact_quantiles(df, "p", [i / n_bins for i in range(n_bins + 1)]))


def _closed(edges) -> list[float]:
    return edges[:-1] + [edges[-1] + TOP]


def bin_of(value: Column, edges) -> Column:
    """0-based bin [edge, next edge) of a value. Equal edges make empty bins."""
    return reduce(lambda a, b: a + b, [(value >= F.lit(e)).cast("int") for e in edges]) - 1


def counted(df: DataFrame) -> DataFrame:
    """(p, pos, neg), one row per scored row unless the table holds counts already."""
    if "pos" in df.columns:
        return df
    y = F.col("y").cast("long")
    return df.select("p", y.alias("pos"), (1 - y).alias("neg"))


def reliability(df: DataFrame, edges) -> DataFrame:
    """Accuracy, confidence and size per bin; a row of zeros for an empty bin."""
    return _bins(_checked(df), edges)


def _bins(df: DataFrame, edges) -> DataFrame:
    p, n, n_bins = F.col("p"), F.col("pos") + F.col("neg"), len(edges) - 1
    right = F.when(p >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    stats = (
        counted(df)
        .groupBy(bin_of(p, edges).alias("bin"))
        .agg(
            (F.sum(right) / F.sum(n)).alias("accuracy"),
            (F.sum(F.greatest(p, 1 - p) * n) / F.sum(n)).alias("confidence"),
            F.sum(n).alias("n"),
        )
    )
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(stats, "bin", "left").na.fill(0)


def edges_for(df: DataFrame, n_bins: int, strategy: str) -> list[float]:
    if strategy == "uniform":
        return uniform_edges(n_bins)
    if strategy == "quantile":
        return quantile_edges(df, n_bins)
    raise ValueError("strategy is 'uniform' or 'quantile'")


def ece(df: DataFrame, n_bins: int = 5, strategy: str = "uniform", name: str = "ece") -> DataFrame:
    """Expected calibration error; with ``strategy='quantile'`` the adaptive variant (ACE)."""
    _checked(df)  # before the quantiles
    return _binned_error(_bins(df, edges_for(df, n_bins, strategy)), name)


def _binned_error(bins: DataFrame, name: str) -> DataFrame:
    error = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return bins.agg((error / F.sum("n")).alias(name))


def calibration_curve(df: DataFrame, normalize: bool = False, n_bins: int = 5) -> DataFrame:
    """Share of positives and mean probability per equal-width bin; (0, 0) for an empty one."""
    s = scored_summary(df).first()
    if s["n_labels"] != 2:
        raise ValueError("only binary classification is supported")
    p = F.col("p")
    if normalize:
        p = (p - s["p_min"]) / (s["p_max"] - s["p_min"])
    elif s["p_min"] < 0 or s["p_max"] > 1:
        raise ValueError("p has values outside [0, 1] and normalize is not set")
    positive = (F.col("y") == s["y_max"]).cast("double")
    stats = (
        df.select(p.alias("p"), positive.alias("positive"))
        .groupBy(bin_of(F.col("p"), uniform_edges(n_bins)).alias("bin"))
        .agg(F.avg("positive").alias("prob_true"), F.avg("p").alias("prob_pred"))
    )
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(stats, "bin", "left").na.fill(0.0)


def score_histogram(df: DataFrame) -> DataFrame:
    """Density of p in percent over 100 unit bins, the last one closed."""
    unit = F.least(F.floor(F.col("p") * 100), F.lit(99)).cast("int")
    counts = df.groupBy(unit.alias("bin")).agg(F.count("*").alias("n"))
    # at most 100 rows from here on
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bins = df.sparkSession.range(100).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(counts, "bin", "left").na.fill(0)
    return full.select("bin", (F.col("n") / total).alias("density"))


# --- ranking ----------------------------------------------------------------------------


def by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with those at higher scores before them."""
    if "pos_above" in df.columns:
        return df
    counts = counted(df).groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    falling = counts.withColumn("_minus_p", -F.col("p"))
    return prefix_sums(falling, ["_minus_p"], {"pos_above": "pos", "neg_above": "neg"}).drop("_minus_p")


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve; a positive and a negative with equal scores count half."""
    won = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return by_score(df).agg((won / F.nullif(pairs, F.lit(0.0))).alias("roc"))


def roc_curve(df: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score taken as threshold."""
    ranked = by_score(df)
    totals = df.agg(
        F.sum(F.col("y").cast("long")).alias("_p"), F.sum(1 - F.col("y").cast("long")).alias("_n")
    ).first()
    positives, negatives = float(totals["_p"] or 0), float(totals["_n"] or 0)
    return ranked.select(
        F.col("p").alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), F.lit(negatives)).alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), F.lit(positives)).alias("tpr"),
    )


def brier(df: DataFrame) -> DataFrame:
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    return counted(_checked(df)).agg((F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.sum(pos + neg)).alias("brier"))


# --- smoothed calibration curve ---------------------------------------------------------


def kde_curve(df: DataFrame, n_bins: int = 100) -> DataFrame:
    """99 rows: sample probability in percent, smoothed share of positives in percent, smoothed
    number of rows. Gaussian kernel of width 1/n_bins over positives and over all rows, each
    curve rescaled to its number of rows.

    Equal scores are counted together first; each distinct score then adds to the 99 grid
    points, and those sums are combined before the shuffle.
    """
    counts = counted(df).groupBy("p").agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    grid = F.array(*[F.lit(i) for i in range(1, 100)])
    z = (F.col("p") - F.col("i") / 100.0) * float(n_bins)
    kernel = F.exp(-0.5 * z * z)
    sums = (
        counts.withColumn("i", F.explode(grid))
        .groupBy("i")
        .agg(
            F.sum(kernel * F.col("pos")).alias("k_pos"),
            F.sum(kernel * F.col("n")).alias("k_all"),
            F.sum("pos").alias("pos"),
            F.sum("n").alias("n"),
        )
    )
    # 99 rows from here on
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos = F.try_divide(F.col("k_pos") * F.col("pos"), F.sum("k_pos").over(whole))
    total = F.try_divide(F.col("k_all") * F.col("n"), F.sum("k_all").over(whole))
    return sums.select(
        F.col("i").cast("double").alias("sample"), pos.alias("pos"), total.alias("n_smoothed")
    ).select(
        "sample",
        F.coalesce(100.0 * F.try_divide(F.col("pos"), F.col("n_smoothed")), F.lit(0.0)).alias("predicted"),
        "n_smoothed",
    )


def mask_curve(curve: DataFrame, min_samples: float) -> DataFrame:
    """Curve points with too few smoothed rows become missing."""
    enough = F.col("n_smoothed") >= min_samples
    return curve.withColumns({c: F.when(enough, F.col(c)) for c in ("sample", "predicted")})


def max_deviation(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max(F.abs(F.col("predicted") - F.col("sample"))).alias("max_dev"))


def residual_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area between the curve and the diagonal, over neighbours that are present."""
    order = Window.orderBy("_at")  # 99 rows
    gap = F.abs(F.col("predicted") - F.col("sample"))
    steps = curve.withColumns({"_at": F.coalesce("sample", F.lit(1000.0)), "_gap": gap}).select(
        ((F.col("sample") - F.lag("sample").over(order)) * (F.col("_gap") + F.lag("_gap").over(order)) / 2.0).alias("_a")
    )
    return steps.agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("residual_area"))


def validate_scores(df: DataFrame) -> tuple[dict, DataFrame]:
    """All scalar metrics of a prediction table (p, y), and the smoothed calibration curve.

    The rows are counted per distinct score and ranked once; all metrics are aggregates of
    that table. Only scalars and the 99 curve points reach the driver.
    """
    scores = materialize(df.select("p", F.col("y").cast("int").alias("y")), "scored")
    check_scored(scores)
    ranked = materialize(by_score(scores), "ranked")
    curve = materialize(kde_curve(ranked).coalesce(1), "curve")
    own = F.col("pos") + F.col("neg")
    total = ranked.agg(F.sum(own)).first()[0]
    ranks = ranked.select("p", own.alias("_n"), (total - own - F.col("pos_above") - F.col("neg_above")).alias("_before"))
    edges = quantiles_of_ranks(ranks, "p", [i / 10 for i in range(11)])
    scalars = {}
    for one in (
        max_deviation(curve), residual_area(curve), roc_auc(ranked), brier(ranked),
        _binned_error(reliability(ranked, uniform_edges(10)), "ece"),
        _binned_error(reliability(ranked, _closed(edges)), "ace"),
    ):
        scalars.update(one.first().asDict())
    return scalars, curve
