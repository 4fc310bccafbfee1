"""Encoders and preprocessing on the order, part, document and shot tables."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.operators import encoders as e
from shotspark.plans import dataset, prep
from workload import adapter
from workload.adapter import sql
from workload.catalog import query, rounded
from workload.newton import newton_grid


@query("select_columns", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def _(spark, sf):
    return e.select_columns(adapter.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])


def _lines(spark, sf, *columns):
    return adapter.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *columns)


def _part(spark, sf, *columns):
    return adapter.table(spark, sf, "part").select("p_partkey", *columns)


@query(
    "tolerant_le",
    """with classes as (select distinct p_type as v from part where p_type not like '%STEEL%'),
       codes as (select t.p_type as value, count(v) as code from (select distinct p_type from part) t
                 left join classes on v < t.p_type group by t.p_type)
select p_partkey, code from part join codes on p_type = value""",
)
def _(spark, sf):
    """Fitted without the types that hold one word, so that these are unseen."""
    parts = _part(spark, sf, F.col("p_type").alias("code"))
    return e.TolerantLE().fit(parts.filter("code not like '%STEEL%'"), "code").transform(parts)


@query(
    "unique_count_select",
    """with counts as (
  select 'l_returnflag' as name, count(distinct coalesce(l_returnflag, '?')) as n from lineitem
  union all select 'l_linestatus', count(distinct l_linestatus) from lineitem
  union all select 'l_linenumber', count(distinct l_linenumber) from lineitem
  union all select 'l_quantity', count(distinct l_quantity) from lineitem
  union all select 'thinned', count(distinct case when l_linenumber % 2 = 0 then l_linestatus end) + 1 from lineitem
  union all select 'l_orderkey', count(distinct l_orderkey) from lineitem)
select name from counts where n between 3 and 8""",
)
def _(spark, sf):
    lines = _lines(
        spark, sf, "l_returnflag", "l_linestatus", "l_quantity",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("thinned"),
    )
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "thinned", "l_orderkey"]
    kept = e.unique_count_select(lines, names, 3, 7)
    return spark.createDataFrame([(n,) for n in kept], "name string")


@query(
    "column_applier",
    """with s as (select min(l_quantity) as q, min(l_extendedprice) as x from lineitem)
select l_orderkey, l_linenumber, round(log10(l_quantity - q + 2), 6) as l_quantity,
       round(log10(l_extendedprice - x + 2), 6) as l_extendedprice from lineitem, s""",
)
def _(spark, sf):
    lines = _lines(spark, sf, "l_quantity", "l_extendedprice")
    return rounded(e.ColumnApplier(e.Logify).fit(lines, ["l_quantity", "l_extendedprice"]).transform(lines))


def ordinal_sql(table, key, column, fit_where, support):
    return f"""with vc as (
  select coalesce({column}, 'nan') as v, count(*) as n from {table} where {fit_where} group by 1),
ranked as (select v, n, row_number() over (order by n desc, v) - 1 as r from vc)
select {key}, cast(case when x = 'nan' then -2 when v is null then -3 when n >= {support} then r else -1 end as integer) as code
from (select {key}, coalesce({column}, 'nan') as x from {table}) t left join ranked on v = x"""


# a brand is missing for every seventh part; part sizes 1 to 5 are held out of the fit
BRAND = "case when p_partkey % 7 = 0 then null else p_brand end"


@query("ordinal_encode", ordinal_sql("part", "p_partkey", f"({BRAND})", "p_size > 5 and p_brand <> 'Brand#11'", 60))
def _(spark, sf):
    parts = _part(spark, sf, "p_size", "p_brand", F.expr(BRAND).alias("code"))
    fitted = e.OrdinalEncoder(60).fit(parts.filter("p_size > 5 and p_brand <> 'Brand#11'"), "code")
    return fitted.transform(parts, key=["p_partkey"]).select("p_partkey", "code")


@query(
    "count_encode",
    f"""with vc as (select {BRAND} as v, count(*) as n from part where p_size > 5 and p_brand <> 'Brand#11' group by 1),
o as (select cast(coalesce(sum(n) filter (v is not null and n < 70), 0) as bigint) as others,
             cast(coalesce(sum(n) filter (v is null), 0) as bigint) as missing from vc)
select p_partkey, case when {BRAND} is null then missing when n >= 70 then n else others end as code
from part left join vc on v = {BRAND}, o""",
)
def _(spark, sf):
    parts = _part(spark, sf, "p_size", "p_brand", F.expr(BRAND).alias("code"))
    fitted = e.CountFrequencyEncoder(70, count_na=True).fit(parts.filter("p_size > 5 and p_brand <> 'Brand#11'"), "code")
    return fitted.transform(parts).select("p_partkey", "code")


@query(
    "tolerant_label",
    """with vc as (select lang || '/' || source as v, count(*) as n from documents where n_chars > 200 group by 1 having count(*) > 10),
codes as (select v, cast(row_number() over (order by n desc, v) as integer) as c from vc)
select doc_id, coalesce(c, 0) as code, v as back from documents left join codes on v = lang || '/' || source""",
)
def _(spark, sf):
    docs = adapter.table(spark, sf, "documents").select("doc_id", "n_chars", F.concat_ws("/", "lang", "source").alias("kind"))
    fitted = e.TolerantLabelEncoder().fit(docs.filter("n_chars > 200"), "kind")
    coded = fitted.transform(docs, "code")
    return fitted.inverse_transform(coded, "code", "back").select("doc_id", "code", "back")


@query(
    "boxcox",
    """with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_orderkey, l_linenumber, round((pow((l_extendedprice - lo) / (hi - lo) + 1e-4, 0.5e0) - 1) / 0.5e0, 6) as l_extendedprice
from lineitem, s""",
)
def _(spark, sf):
    lines = _lines(spark, sf, "l_extendedprice")
    return rounded(e.BoxCox(0.5).fit(lines, "l_extendedprice").transform(lines))


# bisection for the root of the likelihood's slope
@query(
    "boxcox_fit",
    """with recursive s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
v as materialized (select ln(greatest(1e-4, (l_extendedprice - lo) / (hi - lo) + 1e-4)) as l, count(*) as n from lineitem, s group by 1),
t as (select sum(n * l) as logs, sum(n) as total from v),
b as (
  select 0 as it, -5.3e0 as low, 6.1e0 as high
  union all
  select it + 1, case when slope >= 0 then k else low end, case when slope >= 0 then high else k end
  from (select it, low, high, k, any_value(logs) - sum(n) * ((sum(n * u * u * l) / sum(n) - sum(n * u) / sum(n) * sum(n * u * l) / sum(n))
                 / (sum(n * u * u) / sum(n) - pow(sum(n * u) / sum(n), 2)) - 1 / k) as slope
        from (select it, low, high, (low + high) / 2 as k, n, l, logs, exp((low + high) / 2 * l) as u from b, v, t where it < 45) r
        group by it, low, high, k) g)
select round((low + high) / 2, 6) as lmbda, lo as low, hi - lo as width, true as peak from b, s where it = 45""",
)
def _(spark, sf):
    """The fitted exponent, and whether the likelihood falls on both sides of it."""
    lines = _lines(spark, sf, "l_extendedprice")
    fitted = e.BoxCox().fit(lines, "l_extendedprice")
    x = lines.select(fitted._scaled().alias("x"))
    likelihoods = []
    for k in (fitted.lmbda - 1e-3, fitted.lmbda, fitted.lmbda + 1e-3):
        row = x.agg(F.sum(F.log("x")).alias("logs"), F.var_pop(e.BoxCox._power(F.col("x"), k)).alias("v"), F.count("*").alias("n")).first()
        likelihoods.append((k - 1) * row["logs"] - row["n"] / 2 * math.log(row["v"]))
    peak = likelihoods[1] > max(likelihoods[0], likelihoods[2])
    return spark.createDataFrame([(round(fitted.lmbda, 6), fitted.low, fitted.width, peak)], "lmbda double, low double, width double, peak boolean")


@query(
    "logify",
    """select l_orderkey, l_linenumber, round(log10(l_extendedprice - m + 2), 6) as l_extendedprice
from lineitem, (select min(l_extendedprice) as m from lineitem) s""",
)
def _(spark, sf):
    lines = _lines(spark, sf, "l_extendedprice")
    return rounded(e.Logify().fit(lines, "l_extendedprice").transform(lines))


# least squares of log(price + 1) on the quantity
@query(
    "y_to_log",
    """with s as (select regr_slope(ln(l_extendedprice + 1), l_quantity) as b, regr_intercept(ln(l_extendedprice + 1), l_quantity) as a
           from lineitem)
select l_orderkey, l_linenumber, round(exp(a + b * l_quantity) - 1, 2) as prediction from lineitem, s""",
)
def _(spark, sf):
    lines = _lines(spark, sf, "l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines)
    model = e.YToLog(LinearRegression(solver="normal"), shift=1.0).fit(rows)
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 2)


HOLES = "case when (l_orderkey + l_linenumber) % 5 = 0 then null else l_quantity end"


@query("fill_missing", f"select l_orderkey, l_linenumber, coalesce({HOLES}, -1.0e0) as q from lineitem")
def _(spark, sf):
    return e.fill_missing(_lines(spark, sf, F.expr(HOLES).alias("q")), ["q"], -1.0)


@query("as_string", "select p_partkey, cast(p_size as varchar) as p_size from part")
def _(spark, sf):
    return e.as_string(_part(spark, sf, "p_size"), ["p_size"])


def _shots(spark, sf, shot_filter=filters.openplay):
    d = adapter.data(spark, sf)
    frame = dataset.training_frame(d, [fs.startpolar, fs.bodypart], shot_filter, n=1)
    return frame.withColumn("label", F.col("goal").cast("double"))


OOF = ["foot", "head", "other", "d", "a"]
OOF_SCORE = " + ".join(f"b{i} * {c}" for i, c in enumerate(OOF))


@query(
    "stacked_oof",
    sql(f"""with sv as (
  select game_id, action_id, cast((game_id * 31 + action_id) % 3 as integer) as f, result_name = 'success' as goal,
         case when result_name = 'success' then 1.0e0 else 0.0e0 end as y, a0.bodypart_name as part,
         sqrt(pow(105 - a0.start_x, 2) + pow(34 - a0.start_y, 2)) as d,
         case when a0.start_x = 105 then case when a0.start_y = 34 then 0.0e0 else pi() / 2 end
              else atan(abs(34 - a0.start_y) / (105 - a0.start_x)) end as a
  from states where shot_type = 'shot'),
sm as (select k, avg(d) as md, stddev_pop(d) as sd, avg(a) as ma, stddev_pop(a) as sa from sv, range(3) r(k) where f <> k group by k),
sz as (select k, game_id, action_id, f, goal, y, case when part = 'foot' then 1.0e0 else 0.0e0 end as foot,
  case when part = 'head' then 1.0e0 else 0.0e0 end as head, case when part = 'other' then 1.0e0 else 0.0e0 end as other,
  (d - md) / sd as d, (a - ma) / sa as a from sv, sm),
one as (select 0 as i, 1.0e0 as strength, false as balanced),
{newton_grid("sz", OOF, "one")}
select game_id, action_id, goal, round(1 / (1 + exp(-({OOF_SCORE}))), 4) as p from sz join grid on grid.k = sz.k where f = sz.k""", "states"),
)
def _(spark, sf):
    """Out-of-fold probabilities for every shot, next to the label; all folds are fitted together."""
    from shotspark.plans.models import SkLogistic
    from pyspark.ml import Pipeline

    shots = _shots(spark, sf)
    numeric = ["start_dist_to_goal_a0", "start_angle_to_goal_a0"]
    estimator = Pipeline(stages=[prep.prep_linear(numeric, ["bodypart_id_a0"]), SkLogistic(fitIntercept=False)])
    out = e.StackedModel(estimator, dataset.KEY, 3, "int((game_id * 31 + action_id) % 3)").fit_transform(shots)
    return out.select(*dataset.KEY, "goal", F.round(vector_to_array("probability")[1], 4).alias("p"))


@query(
    "to_1d",
    "select vec_id, round(sum(cast(v as double)), 4) as total from (select vec_id, unnest(embedding) as v from embeddings) t group by vec_id",
)
def _(spark, sf):
    """Flattened vectors, added up per vector for comparison."""
    vectors = adapter.table(spark, sf, "embeddings")
    tagged = vectors.select(F.transform("embedding", lambda v: F.struct("vec_id", v.cast("double").alias("v"))).alias("all"))
    flat = e.to_1d(tagged, "all")
    return rounded(flat.groupBy("value.vec_id").agg(F.sum("value.v").alias("total")), 4)


ORDER_PAIRS = """coded as (
  select coalesce(r.code, 0) as row, coalesce(c.code, 0) as col, o_totalprice from orders
  left join (select v, row_number() over (order by n desc, v) as code
             from (select o_custkey as v, count(*) as n from orders group by 1 having count(*) > 10) x) r on r.v = o_custkey
  left join (select v, row_number() over (order by n desc, v) as code
             from (select o_orderpriority as v, count(*) as n from orders group by 1 having count(*) > 10) y) c on c.v = o_orderpriority)"""


def _orders(spark, sf):
    return adapter.table(spark, sf, "orders").withColumn("buyer", F.col("o_custkey"))


@query(
    "svd_pairs",
    f"with {ORDER_PAIRS} select cast(row as integer) as row, cast(col as integer) as col, round(avg(o_totalprice), 6) as value from coded group by 1, 2",
)
def _(spark, sf):
    """The matrix that is decomposed: mean price per buyer and priority."""
    return rounded(e.SVDEmbedding("buyer", "o_orderpriority", "o_totalprice").pairs(_orders(spark, sf)))


# the two leading right vectors by power steps on the products of columns, the second kept apart from the first
@query(
    "svd_embedding",
    f"""with recursive {ORDER_PAIRS},
cells as materialized (select row, col, avg(o_totalprice) as value from coded group by 1, 2),
cols as (select col, row_number() over (order by col) as i from (select distinct col from cells)),
wide as materialized (
  select r.row, list(coalesce(c.value, 0) order by k.i) as x from (select distinct row from cells) r cross join cols k
  left join cells c on c.row = r.row and c.col = k.col group by r.row),
size as (select count(*) as n from cols),
g as materialized (
  select list(line order by i) as m from (
    select i, list(p order by j) as line from (
      select i, j, sum(x[i] * x[j]) as p from wide, (select unnest(range(1, n + 1)) as i from size) a1,
        (select unnest(range(1, n + 1)) as j from size) a2 group by i, j) group by i)),
power as (
  select 0 as it, list_transform(range(1, n + 1), lambda i: cos(i * 1.3e0)) as v, list_transform(range(1, n + 1), lambda i: sin(i * 2.1e0)) as w from size
  union all
  select it + 1, v, list_transform(range(1, len(w) + 1), lambda i: w[i] / sqrt(list_dot_product(w, w))) from (
    select it, v, list_transform(range(1, len(w) + 1), lambda i: w[i] - v[i] * list_dot_product(v, w)) as w from (
      select it, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v, w from (
        select it, list_transform(m, lambda line: list_dot_product(line, v)) as v, list_transform(m, lambda line: list_dot_product(line, w)) as w
        from power, g where it < 3000)))),
parts as (select row, pow(list_dot_product(x, v), 2) + pow(list_dot_product(x, w), 2) as square from wide, power where it = 3000),
codes as (select v, row_number() over (order by n desc, v) as code
          from (select o_custkey as v, count(*) as n from orders group by 1 having count(*) > 10) x)
select buyer, round(sqrt(square), 2) as size from (select distinct o_custkey as buyer from orders) o
left join codes on v = buyer join parts on row = coalesce(code, 0)""",
)
def _(spark, sf):
    """Length of the embedding of each buyer in two dimensions (the sign of a component is free)."""
    orders = _orders(spark, sf)
    fitted = e.SVDEmbedding("buyer", "o_orderpriority", "o_totalprice", k=2).fit(orders)
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    return fitted.transform(orders.select("buyer").distinct()).select("buyer", F.round(F.sqrt(squared), 2).alias("size"))


@query(
    "impute_mean",
    f"""select l_orderkey, l_linenumber, round(coalesce({HOLES}, m), 6) as q
from lineitem, (select avg({HOLES}) as m from lineitem) s""",
)
def _(spark, sf):
    lines = _lines(spark, sf, F.expr(HOLES).alias("q"))
    return rounded(e.ImputeMean().fit(lines, ["q"]).transform(lines))


@query(
    "standard_scale",
    """select l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) as l_quantity, 0.0e0 as one
from lineitem, (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem) t""",
)
def _(spark, sf):
    lines = _lines(spark, sf, "l_quantity", F.lit(1.0).alias("one"))
    return rounded(e.StandardScale().fit(lines, ["l_quantity", "one"]).transform(lines))


@query(
    "one_hot",
    """select p_partkey, case when b = 'Brand#11' then 1.0e0 else 0.0e0 end as b_1,
       case when b = 'Brand#12' then 1.0e0 else 0.0e0 end as b_2, case when b = 'nan' then 1.0e0 else 0.0e0 end as b_3
from (select p_partkey, coalesce(%s, 'nan') as b from part) t""" % BRAND,
)
def _(spark, sf):
    """Fitted on two brands and missing values; all others are unseen."""
    parts = _part(spark, sf, F.expr(BRAND).alias("b"))
    return e.OneHot().fit(parts.filter("b in ('Brand#11', 'Brand#12') or b is null"), "b").transform(parts)


def _slots(df, n, key):
    values = vector_to_array("features")
    return df.select(*key, *[F.round(values[i], 6).alias(f"f{i}") for i in range(n)])


SHOTS = """shots as (
  select game_id, action_id, bodypart_name as b, sqrt(pow(105 - x, 2) + pow(34 - y, 2)) as d,
         case when x = 105 then case when y = 34 then 0.0e0 else pi() / 2 end else atan(abs(34 - y) / (105 - x)) end as a
  from (select a.game_id, action_id, bodypart_name,
               case when team_id <> home_team_id then 105 - start_x else start_x end as x,
               case when team_id <> home_team_id then 68 - start_y else start_y end as y
        from actions a join games g on a.game_id = g.game_id
        where type_name = 'shot' and result_name in ('success', 'fail')) s),
stats as (select avg(d) as md, stddev_pop(d) as sd, avg(a) as ma, stddev_pop(a) as sa from shots)"""

NUMERIC = ["start_dist_to_goal_a0", "start_angle_to_goal_a0"]


@query(
    "prep_linear",
    sql(f"""with {SHOTS} select game_id, action_id, case when b = 'foot' then 1.0e0 else 0.0e0 end as f0,
       case when b = 'head' then 1.0e0 else 0.0e0 end as f1, case when b = 'other' then 1.0e0 else 0.0e0 end as f2,
       round((d - md) / sd, 6) as f3, round((a - ma) / sa, 6) as f4 from shots, stats"""),
)
def _(spark, sf):
    shots = _shots(spark, sf)
    return _slots(prep.prep_linear(NUMERIC, ["bodypart_id_a0"]).fit(shots).transform(shots), 5, dataset.KEY)


@query(
    "prep_tree",
    sql(f"""with {SHOTS}, vc as (select b as v, count(*) as n, row_number() over (order by count(*) desc, b) - 1 as r from shots group by 1)
select game_id, action_id, case when n >= 5 then cast(r as double) else -1.0e0 end as f0,
       round((d - md) / sd, 6) as f1, round((a - ma) / sa, 6) as f2 from shots join vc on v = b, stats"""),
)
def _(spark, sf):
    shots = _shots(spark, sf)
    return _slots(prep.prep_tree(NUMERIC, ["bodypart_id_a0"]).fit(shots).transform(shots), 3, dataset.KEY)
