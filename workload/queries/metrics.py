"""Evaluation metrics on the deterministic scores."""

from pyspark.sql import functions as F

from shotspark.operators import metrics as m
from workload import adapter
from workload.adapter import sql
from workload.catalog import query, rounded


def bins_sql(edges_cte, n_bins):
    """Views ``edges(bin, low, high)`` and ``bins(bin, accuracy, confidence, n)``."""
    return f"""with {edges_cte},
bins as (
  select bin, coalesce(accuracy, 0) as accuracy, coalesce(confidence, 0) as confidence, coalesce(n, 0) as n
  from (select unnest(range(0, {n_bins})) as bin) b
  left join (
    select e.bin as found, avg(case when (p >= 0.5) = (y = 1) then 1.0e0 else 0.0e0 end) as accuracy,
           avg(greatest(p, 1 - p)) as confidence, count(*) as n
    from scored join edges e on p >= low and p < high group by e.bin) s on bin = found)"""


def uniform(n_bins):
    return f"""edges as (
  select i as bin, i * (1.00000001e0 / {n_bins}) as low,
         case when i = {n_bins - 1} then 1.00000001e0 else (i + 1) * (1.00000001e0 / {n_bins}) end as high
  from (select unnest(range(0, {n_bins})) as i) r)"""


def quantile(n_bins):
    probs = ", ".join(repr(i / n_bins) for i in range(n_bins + 1))
    return f"""cuts as (select quantile_cont(p, [{probs}]) as q from scored),
edges as (
  select i as bin, q[i + 1] as low, case when i = {n_bins - 1} then q[i + 2] + 1e-8 else q[i + 2] end as high
  from cuts, (select unnest(range(0, {n_bins})) as i) r)"""


ERROR = "sum(n * abs(accuracy - confidence)) / sum(n)"


@query("ece_uniform", sql(f"{bins_sql(uniform(5), 5)} select round({ERROR}, 6) as ece from bins", "scored"))
def _(spark, sf):
    return rounded(m.ece(adapter.scored(spark, sf)))


@query("ece_quantile", sql(f"{bins_sql(quantile(10), 10)} select round({ERROR}, 6) as ace from bins", "scored"))
def _(spark, sf):
    return rounded(m.ece(adapter.scored(spark, sf), 10, "quantile", "ace"))


@query(
    "reliability_bins",
    sql(
        f"""{bins_sql(uniform(90), 90)} select bin, round(accuracy, 6) as accuracy,
round(confidence, 6) as confidence, n from bins""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(m.reliability(adapter.scored(spark, sf), m.uniform_edges(90)))


ROC = """counts as (select p, sum(y) as pos, sum(1 - y) as neg from scored group by p),
ranked as (
  select p, cast(sum(pos) over w as double) as tp, cast(sum(neg) over w as double) as fp, pos, neg,
         cast(sum(pos) over () as double) as np, cast(sum(neg) over () as double) as nn
  from counts window w as (order by p desc))"""

AUC = "sum(neg * (tp - pos / 2.0e0)) / max(np * nn)"


@query("roc_auc", sql(f"with {ROC} select round({AUC}, 6) as roc from ranked", "scored"))
def _(spark, sf):
    return rounded(m.roc_auc(adapter.scored(spark, sf)))


@query(
    "roc_curve",
    sql(f"with {ROC} select round(p, 6) as threshold, round(fp / nn, 6) as fpr, round(tp / np, 6) as tpr from ranked", "scored"),
)
def _(spark, sf):
    return rounded(m.roc_curve(adapter.scored(spark, sf)))


@query("brier", sql("select round(avg((p - y) * (p - y)), 6) as brier from scored", "scored"))
def _(spark, sf):
    return rounded(m.brier(adapter.scored(spark, sf)))


KDE = """raw as (
  select i, sum(exp(-0.5e0 * pow((p - i / 100.0e0) * 100.0e0, 2)) * y) as kp,
         sum(exp(-0.5e0 * pow((p - i / 100.0e0) * 100.0e0, 2))) as ka,
         cast(sum(y) as double) as np, cast(count(*) as double) as n
  from scored, (select unnest(range(1, 100)) as i) g group by i),
curve as (
  select sample, coalesce(100.0e0 * pos / nullif(n_smoothed, 0), 0) as predicted, n_smoothed
  from (select cast(i as double) as sample, kp * np / sum(kp) over () as pos,
               ka * n / sum(ka) over () as n_smoothed from raw) s)"""

AREA = """select round(sum((sample - s0) * (gap + g0) / 2.0e0), 6) as residual_area
from (select sample, gap, lag(sample) over (order by sample) as s0, lag(gap) over (order by sample) as g0
      from (select sample, abs(predicted - sample) as gap from curve) c) d"""


@query(
    "kde_calibration",
    sql(f"with {KDE} select sample, round(predicted, 6) as predicted, round(n_smoothed, 6) as n_smoothed from curve", "scored"),
)
def _(spark, sf):
    return rounded(m.kde_curve(adapter.scored(spark, sf)))


@query("max_deviation", sql(f"with {KDE} select round(max(abs(predicted - sample)), 6) as max_dev from curve", "scored"))
def _(spark, sf):
    return rounded(m.max_deviation(m.kde_curve(adapter.scored(spark, sf))))


@query("residual_area", sql(f"with {KDE} {AREA}", "scored"))
def _(spark, sf):
    return rounded(m.residual_area(m.kde_curve(adapter.scored(spark, sf))))


# smoothed counts are about N/99 per point
MASKED = """limits as (select avg(n_smoothed) as k from curve),
masked as (
  select case when n_smoothed >= k then sample end as sample,
         case when n_smoothed >= k then predicted end as predicted, n_smoothed from curve, limits)"""


@query(
    "min_samples_mask",
    sql(
        f"""with {KDE}, {MASKED}
select sample, round(predicted, 6) as predicted, round(n_smoothed, 6) as n_smoothed,
       (select round(max(abs(predicted - sample)), 6) from masked) as max_dev from masked""",
        "scored",
    ),
)
def _(spark, sf):
    """Points with fewer rows than the average point are masked."""
    curve = m.kde_curve(adapter.scored(spark, sf))
    k = curve.agg(F.avg("n_smoothed")).first()[0]
    masked = m.mask_curve(curve, k)
    deviation = m.max_deviation(masked).first()[0]
    return rounded(masked.withColumn("max_dev", F.lit(deviation)))


@query(
    "validate_all",
    sql(
        f"""{bins_sql(uniform(10), 10)},
{quantile(10).replace("edges as", "qedges as")},
qbins as (
  select e.bin, avg(case when (p >= 0.5) = (y = 1) then 1.0e0 else 0.0e0 end) as accuracy,
         avg(greatest(p, 1 - p)) as confidence, count(*) as n
  from scored join qedges e on p >= low and p < high group by e.bin),
{ROC}, {KDE}
select (select round(max(abs(predicted - sample)), 6) from curve) as max_dev,
       ({AREA}) as residual_area,
       (select round({AUC}, 6) from ranked) as roc,
       (select round(avg((p - y) * (p - y)), 6) from scored) as brier,
       (select round({ERROR}, 6) from bins) as ece,
       (select round({ERROR}, 6) from qbins) as ace""",
        "scored",
    ),
)
def _(spark, sf):
    scalars, _curve = m.validate_scores(adapter.scored(spark, sf))
    names = ["max_dev", "residual_area", "roc", "brier", "ece", "ace"]
    return rounded(spark.createDataFrame([tuple(scalars[n] for n in names)], ", ".join(f"{n} double" for n in names)))


def curve_sql(p):
    return f"""with {uniform(5)}, s as (select {p} as p, y from scored)
select bin, round(coalesce(prob_true, 0), 6) as prob_true, round(coalesce(prob_pred, 0), 6) as prob_pred
from (select unnest(range(0, 5)) as bin) b
left join (select e.bin as found, avg(cast(y as double)) as prob_true, avg(p) as prob_pred
           from s join edges e on p >= low and p < high group by e.bin) t on bin = found"""


@query("calibration_curve", sql(curve_sql("p"), "scored"))
def _(spark, sf):
    return rounded(m.calibration_curve(adapter.scored(spark, sf)))


@query(
    "calibration_curve_normalized",
    sql(
        curve_sql("p").replace(
            "select p as p, y from scored",
            "select (p * 3 + 1 - lo) / (hi - lo) as p, y from scored, (select min(p * 3 + 1) as lo, max(p * 3 + 1) as hi from scored) r",
        ),
        "scored",
    ),
)
def _(spark, sf):
    """Scores outside [0, 1] are mapped to it."""
    wide = adapter.scored(spark, sf).withColumn("p", F.col("p") * 3 + 1)
    return rounded(m.calibration_curve(wide, normalize=True))


@query(
    "score_histogram",
    sql(
        """select bin, round(coalesce(n, 0) / (select cast(count(*) as double) from scored), 6) as density
from (select unnest(range(0, 100)) as bin) b
left join (select cast(least(floor(p * 100), 99) as integer) as found, count(*) as n from scored group by 1) s on bin = found""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(m.score_histogram(adapter.scored(spark, sf)))


@query(
    "input_checks",
    sql(
        """select count(*) as n, round(min(p), 6) as p_min, round(max(p), 6) as p_max,
       count(*) filter (p is null) as n_missing, count(*) filter (y is null) as n_unlabelled, min(y) as y_min, max(y) as y_max,
       count(distinct y) as n_labels from scored""",
        "scored",
    ),
)
def _(spark, sf):
    scored = adapter.scored(spark, sf)
    m.check_scored(scored, both_labels=True)
    return rounded(m.scored_summary(scored))
