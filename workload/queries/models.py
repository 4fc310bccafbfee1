"""Training, scoring, search, calibration. Fits have no SQL text; the tests recompute them."""

from dataclasses import replace
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.operators import report
from shotspark.plans import calibrate, dataset, models, prep, search, treelr
from shotspark.scale import materialize, scratch_path
from shotspark.sources import tables
from workload import adapter
from workload.adapter import sql
from workload.catalog import query, rounded
from workload.newton import elimination, newton, newton_grid

KEY = dataset.KEY
NUMERIC = ["start_x_a0", "start_y_a0", "start_dist_to_goal_a0", "shot_angle_a0"]
CATEGORIC = ["bodypart_id_a0"]


def _seasons(season):
    return [(c, season) for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]


def _season_games(spark, sf, season):
    return tables.select_games(adapter.games(spark, sf), _seasons(season))


def flagship(spark, sf):
    """Default models trained on one season; the players with the most xG in the other."""
    data = adapter.data(spark, sf)
    model = models.CompositeModel().train(data, _seasons("1718"))
    xg = model.estimate(data, _season_games(spark, sf, "1819"), keep=["player_id"])
    return report.top_players(xg, data.players)


# its query is registered below, next to the SQL of the models it uses


# --- default models ---------------------------------------------------------------------


def _shots_sql(where):
    """View ``s``: shots playing left to right, with distance, angle and label."""
    return f"""s as (
  select game_id, action_id, season_id, bodypart_name, case when result_name = 'success' then 1.0e0 else 0.0e0 end as y,
         sqrt(pow(105 - x, 2) + pow(34 - y0, 2)) as d,
         case when x = 105 then case when y0 = 34 then 0.0e0 else pi() / 2 end else atan(abs(34 - y0) / (105 - x)) end as a
  from (select a.*, season_id,
               case when team_id <> home_team_id then 105 - start_x else start_x end as x,
               case when team_id <> home_team_id then 68 - start_y else start_y end as y0
        from actions a join games g on a.game_id = g.game_id) t where {where})"""


def _scaled(rows, stats):
    return f"""select game_id, action_id, 1.0e0 as w, 1.0e0 as one, y, (d - md) / sd as d, (a - ma) / sa as a,
         case when bodypart_name = 'foot' then 1.0e0 else 0.0e0 end as foot,
         case when bodypart_name = 'head' then 1.0e0 else 0.0e0 end as head,
         case when bodypart_name = 'other' then 1.0e0 else 0.0e0 end as other from {rows}, {stats}"""


def _predictions(where, columns, penalty):
    """Fit on season 1718, predict season 1819."""
    score = " + ".join(f"b{i} * {c}" for i, c in enumerate(columns))
    return f"""with {_shots_sql(where)}, tr as (select * from s where season_id = '1718'),
te as (select * from s where season_id = '1819'),
st as (select avg(d) as md, stddev_pop(d) as sd, avg(a) as ma, stddev_pop(a) as sa from tr),
z as ({_scaled("tr", "st")}), zt as ({_scaled("te", "st")}),
{newton("z", columns, penalty)}
select game_id, action_id, 1 / (1 + exp(-({score}))) as xg from zt, fitted"""


def _predict_sql(where, columns, penalty):
    return sql(f"""select game_id, action_id, round(xg, 3) as "xG" from ({_predictions(where, columns, penalty)}) t""")


COEFFICIENTS = ["foot", "head", "other", "d", "a"]
OPENPLAY = "type_name = 'shot' and result_name in ('fail', 'success')"
COUNTED = "type_name in ('shot', 'shot_penalty', 'shot_freekick') and result_name in ('fail', 'success')"


@query("openplay_fit_predict", _predict_sql(OPENPLAY, COEFFICIENTS, [1] * 5))
def _(spark, sf):
    data = adapter.data(spark, sf)
    model = models.OpenplayModel().train(data, _seasons("1718"))
    return rounded(model.estimate(data, _season_games(spark, sf, "1819")), 3)


@query("freekick_fit_predict", _predict_sql("type_name = 'shot_freekick'", ["d", "a", "one"], [1, 1, 0]))
def _(spark, sf):
    data = adapter.data(spark, sf)
    model = models.FreekickModel().train(data, _seasons("1718"))
    return rounded(model.estimate(data, _season_games(spark, sf, "1819")), 3)


@query("penalty_predict", sql("""select game_id, action_id, 0.792453e0 as "xG" from actions where type_name = 'shot_penalty'"""))
def _(spark, sf):
    return models.PenaltyModel().estimate(adapter.data(spark, sf))


@query(
    "composite_predict",
    sql(f"""select game_id, action_id, round(xg, 3) as "xG" from (
  select * from ({_predictions(OPENPLAY, COEFFICIENTS, [1] * 5)}) o
  union all select * from ({_predictions("type_name = 'shot_freekick'", ["d", "a", "one"], [1, 1, 0])}) f
  union all select a.game_id, action_id, 0.792453e0 from actions a join games g on a.game_id = g.game_id
    where type_name = 'shot_penalty' and season_id = '1819') x"""),
)
def _(spark, sf):
    """Every shot once, scored by the model of its kind."""
    data = adapter.data(spark, sf)
    model = models.CompositeModel().train(data, _seasons("1718"))
    return rounded(model.estimate(data, _season_games(spark, sf, "1819")), 3)


@query(
    "flagship_top_players",
    sql(
        f"""select player_id, player_name, round(xg, 2) as "xG" from (
  select a.player_id, any_value(player_name) as player_name, sum(xg) as xg from (
    select * from ({_predictions(OPENPLAY, COEFFICIENTS, [1] * 5)}) o
    union all select * from ({_predictions("type_name = 'shot_freekick'", ["d", "a", "one"], [1, 1, 0])}) f
    union all select a.game_id, action_id, 0.792453e0 from actions a join games g on a.game_id = g.game_id
      where type_name = 'shot_penalty' and season_id = '1819') x
  join actions a on a.game_id = x.game_id and a.action_id = x.action_id
  left join players on players.player_id = a.player_id
  group by a.player_id order by xg desc, a.player_id limit 10) t""",
        "players",
    ),
)
def _(spark, sf):
    return rounded(flagship(spark, sf), 2)


@query("single_model", _predict_sql(COUNTED, COEFFICIENTS, [1] * 5))
def _(spark, sf):
    data = adapter.data(spark, sf)
    return rounded(models.ShotModel().train(data, _seasons("1718")).estimate(data, _season_games(spark, sf, "1819")), 3)


@query(
    "user_filter",
    sql("""select game_id, action_id, result_name = 'success' as goal from states where a0.bodypart_name = 'head' and a0.start_x >= 88""", "states"),
)
def _(spark, sf):
    """Labels of the shots that an own filter takes: headers from the last seventeen metres."""
    data = adapter.data(spark, sf)

    def headers_nearby(a):
        # the place is compared as the shooting team sees it
        away = F.col("team_id") != F.col("home_team_id")
        x = F.when(away, 105 - a("start_x")).otherwise(a("start_x"))
        return filters.any_shot(a) & filters.is_any(a, "bodypart", "head") & (x >= 88)

    homes = data.games.select("game_id", "home_team_id")
    return dataset.shot_labels(replace(data, actions=data.actions.join(homes, "game_id")), headers_nearby)


@query("user_pipeline", _predict_sql(OPENPLAY, ["d", "a", "one"], [2, 2, 0]))
def _(spark, sf):
    """An own pipeline in place of the default one."""
    data = adapter.data(spark, sf)
    numeric = ["start_dist_to_goal_a0", "start_angle_to_goal_a0"]
    pipeline = Pipeline(stages=[prep.prep_linear(numeric, []), models.SkLogistic(C=0.5)])
    model = models.OpenplayModel(pipeline).train(data, _seasons("1718"))
    return rounded(model.estimate(data, _season_games(spark, sf, "1819")), 3)


LISTED = list(range(1, 2000, 7))


@query(
    "estimate_games",
    sql(f"""select game_id, action_id, round(xg, 3) as "xG" from ({_predictions(OPENPLAY, COEFFICIENTS, [1] * 5)}) t
where game_id in ({", ".join(map(str, LISTED))})"""),
)
def _(spark, sf):
    """Shots of the games of a list, those of the other season among them."""
    data = adapter.data(spark, sf)
    model = models.OpenplayModel().train(data, _seasons("1718"))
    listed = _season_games(spark, sf, "1819").filter(F.col("game_id").isin(LISTED))
    return rounded(model.estimate(data, [r["game_id"] for r in listed.select("game_id").collect()]), 3)


@query(
    "model_store",
    sql(f"""select a.game_id, action_id, true as same from actions a join games g on a.game_id = g.game_id
where season_id = '1819' and (({OPENPLAY}) or type_name in ('shot_penalty', 'shot_freekick'))"""),
)
def _(spark, sf):
    """A stored and reloaded composite model gives the scores of the original."""
    data = adapter.data(spark, sf)
    model = models.CompositeModel().train(data, _seasons("1718"))
    folder = scratch_path(spark, "models")
    model.save(spark, folder)
    loaded = models.ShotModel.load(spark, folder)
    games = _season_games(spark, sf, "1819")
    both = model.estimate(data, games).join(loaded.estimate(data, games).withColumnRenamed("xG", "xG_loaded"), KEY)
    return both.select(*KEY, (F.abs(F.col("xG") - F.col("xG_loaded")) < 1e-12).alias("same"))


@query("model_validate")
def _(spark, sf):
    data = adapter.data(spark, sf)
    model = models.OpenplayModel().train(data, _seasons("1718"))
    scalars, _curve = model.validate(data, _seasons("1819"))
    return rounded(spark.createDataFrame([scalars], ", ".join(f"{n} double" for n in scalars)))


def _shot_rows(where):
    """View ``z``: all these shots, scaled by their own mean and deviation."""
    return f"""{_shots_sql(where)},
st as (select avg(d) as md, stddev_pop(d) as sd, avg(a) as ma, stddev_pop(a) as sa from s),
z as ({_scaled("s", "st")})"""


NAMES = ["bodypart_id_a0__h_foot", "bodypart_id_a0__h_head", "bodypart_id_a0__h_other",
         "start_dist_to_goal_a0__z", "start_angle_to_goal_a0__z"]


@query(
    "predict_coefficients",
    sql(
        f"""with {_shot_rows(OPENPLAY)},
{newton("z", COEFFICIENTS, [1] * 5)}
{" union all ".join(f"select '{name}' as feature, round(b{i}, 3) as coefficient from fitted" for i, name in enumerate(NAMES))}"""
    ),
)
def _(spark, sf):
    data = adapter.data(spark, sf)
    model = models.OpenplayModel().train(data)
    frame = dataset.shot_features(data, model.generators, filters.openplay, 1)
    return rounded(models.coefficients(spark, model.fitted, frame), 3)


@query(
    "freekick_coefficients",
    sql(
        f"""with {_shot_rows("type_name = 'shot_freekick'")}, {newton("z", ["d", "a", "one"], [1, 1, 0])}
select round(b0, 3) as distance, round(b1, 3) as angle, round(b2, 3) as intercept from fitted"""
    ),
)
def _(spark, sf):
    """The free-kick model, whose intercept is not penalised."""
    model = models.FreekickModel().train(adapter.data(spark, sf)).fitted.stages[-1]
    row = (*[float(v) for v in model.coefficients], float(model.intercept))
    return rounded(spark.createDataFrame([row], "distance double, angle double, intercept double"), 3)


@query(
    "weighted_coefficients",
    sql(
        f"""with {_shot_rows(OPENPLAY)},
bal as (select * replace (case when y = 1 then count(*) over () / (2.0e0 * sum(y) over ())
                               else count(*) over () / (2.0e0 * sum(1 - y) over ()) end as w) from z),
{newton("bal", ["d", "a", "one"], [4, 4, 0])}
select round(b0, 3) as distance, round(b1, 3) as angle, round(b2, 3) as intercept from fitted"""
    ),
)
def _(spark, sf):
    """Balanced class weights and a stronger penalty, as searches draw them."""
    rows = dataset.training_frame(adapter.data(spark, sf), [fs.startpolar], filters.openplay, n=1)
    rows = materialize(rows.withColumn("label", F.col("goal").cast("double")), "training")
    pipeline = Pipeline(stages=[
        prep.prep_linear(["start_dist_to_goal_a0", "start_angle_to_goal_a0"], []),
        models.SkLogistic(C=0.25, classWeight="balanced"),
    ])
    model = pipeline.fit(rows).stages[-1]
    row = (*[float(v) for v in model.coefficients], float(model.intercept))
    return rounded(spark.createDataFrame([row], "distance double, angle double, intercept double"), 3)


def _bodyparts(spark, sf):
    return adapter.actions(spark, sf).select(F.col("bodypart_name").alias("bodypart_id")).distinct()


@query(
    "xg_surface",
    sql(
        f"""with {_shot_rows(OPENPLAY)},
{newton("z", COEFFICIENTS, [1] * 5)},
cells as (
  select b.bodypart_name, cast(x as double) as x, cast(y as double) as y, sqrt(pow(105 - x, 2) + pow(34 - y, 2)) as d,
         case when x = 105 then case when y = 34 then 0.0e0 else pi() / 2 end
              else atan(abs(34 - y) / cast(105 - x as double)) end as a
  from (select distinct bodypart_name from actions) b, range(0, 106) t1(x), range(0, 69) t2(y))
select bodypart_name as bodypart_id_a0, x, y, round(1 / (1 + exp(-(
  case bodypart_name when 'foot' then b0 when 'head' then b1 else b2 end + b3 * (d - md) / sd + b4 * (a - ma) / sa))), 2) as "xG"
from cells, st, fitted"""
    ),
)
def _(spark, sf):
    model = models.OpenplayModel().train(adapter.data(spark, sf))
    return rounded(models.surface(model, _bodyparts(spark, sf)), 2)


# --- open-play shots of the custom models -----------------------------------------------


def _openplay(spark, sf):
    generators = [fs.startlocation, fs.startpolar, fs.goalangle, fs.bodypart]
    frame = dataset.training_frame(adapter.data(spark, sf), generators, filters.openplay, n=1)
    return frame.withColumn("label", F.col("goal").cast("double"))


def _split(spark, sf):
    """Train, validation and test rows by the date of the game."""
    games = tables.sample_temporal(adapter.games(spark, sf), 0.2, 0.3).select("game_id", "split")
    rows = materialize(_openplay(spark, sf).join(games, "game_id"), "split")
    return [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]


def _logistic():
    return Pipeline(stages=[prep.prep_linear(NUMERIC, CATEGORIC), models.SkLogistic()])


FOLD = "int((game_id * 31 + action_id) % 5)"  # both engines can compute it


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v) for v in r) + ")" for r in rows)


SEARCH_COLUMNS = ["foot", "head", "other", "x", "y0", "d", "a"]
#: Open-play shots with the features of the searches, five times: scaled by the rows outside of fold k.
SEARCH_ROWS = """sv as (
  select game_id, action_id, (game_id * 31 + action_id) % 5 as f, case when result_name = 'success' then 1.0e0 else 0.0e0 end as y, a0.bodypart_name as part,
         a0.start_x as x, a0.start_y as y0, sqrt(pow(105 - a0.start_x, 2) + pow(34 - a0.start_y, 2)) as d,
         case when a0.start_x = 105 and a0.start_y between 30.35e0 and 37.65e0 then pi() when a0.start_x >= 105 then 0.0e0
              else t + case when t < 0 then pi() else 0.0e0 end end as a
  from (select *, atan(7.3e0 * (105 - a0.start_x) / (pow(105 - a0.start_x, 2) + pow(34 - a0.start_y, 2) - 13.3225e0)) as t
        from states where shot_type = 'shot') s),
sm as (select k, avg(x) as mx, stddev_pop(x) as sx, avg(y0) as my, stddev_pop(y0) as sy, avg(d) as md, stddev_pop(d) as sd,
              avg(a) as ma, stddev_pop(a) as sa from sv, range(5) r(k) where f <> k group by k),
sz as (select k, f, y, case when part = 'foot' then 1.0e0 else 0.0e0 end as foot, case when part = 'head' then 1.0e0 else 0.0e0 end as head,
              case when part = 'other' then 1.0e0 else 0.0e0 end as other, (x - mx) / sx as x, (y0 - my) / sy as y0, (d - md) / sd as d,
              (a - ma) / sa as a from sv, sm)"""


SEARCH_SCORE = " + ".join(f"b{i} * {c}" for i, c in enumerate(SEARCH_COLUMNS))


def _search_views(draws):
    """Views that end in ``found`` (i, parameters, strength, balanced, score)."""
    rows = [(i, 1 / d["C"], d["classWeight"] == "balanced", search.parameter_text(d)) for i, d in enumerate(draws)]
    return f"""{SEARCH_ROWS}, cand as (select * from (values {_values(rows)}) t(i, strength, balanced, parameters)),
{newton_grid("sz", SEARCH_COLUMNS, "cand", 12)},
per as (select g.k, i, avg(pow(1 / (1 + exp(-({SEARCH_SCORE}))) - y, 2)) as s from sz join grid g on sz.k = g.k where sz.f = sz.k group by g.k, i),
found as (select i, any_value(parameters) as parameters, any_value(strength) as strength, any_value(balanced) as balanced, avg(s) as score
  from per join cand using (i) group by i)"""


def _search_sql(draws):
    return sql(f"with {_search_views(draws)} select cast(i as integer) as draw, parameters, round(score, 5) as score from found", "states")


def _best_sql(draws):
    """The best draw, fitted on all rows."""
    return sql(
        f"""with {_search_views(draws)},
best as (select 0 as i, strength, balanced from found order by score, i limit 1),
am as (select avg(x) as mx, stddev_pop(x) as sx, avg(y0) as my, stddev_pop(y0) as sy, avg(d) as md, stddev_pop(d) as sd,
              avg(a) as ma, stddev_pop(a) as sa from sv),
az as (select 9 as k, f, game_id, action_id, y, case when part = 'foot' then 1.0e0 else 0.0e0 end as foot, case when part = 'head' then 1.0e0 else 0.0e0 end as head,
              case when part = 'other' then 1.0e0 else 0.0e0 end as other, (x - mx) / sx as x, (y0 - my) / sy as y0, (d - md) / sd as d,
              (a - ma) / sa as a from sv, am),
{newton_grid("az", SEARCH_COLUMNS, "best", 12, prefix="b_")},
p as (select game_id, action_id, y, 1 / (1 + exp(-({SEARCH_SCORE}))) as p from az, b_grid)
select game_id, action_id, round(p, 3) as "xG", round((select avg(pow(p - y, 2)) from p), 5) as brier from p""",
        "states",
    )


def _logreg_search():
    return search.logreg_search(NUMERIC, CATEGORIC, scoring="brier", fold=FOLD)


@query("search_logreg", _search_sql(_logreg_search().draws))
def _(spark, sf):
    """100 draws and 5 folds."""
    found = _logreg_search()
    return rounded(found.table(found.fit(_openplay(spark, sf))), 5)


@query("search_logreg_gradient")
def _(spark, sf):
    """100 draws and 5 folds, half of them with an l1 penalty."""
    found = search.logreg_search(NUMERIC, CATEGORIC, learning_rate="optimal", fold=FOLD)
    return rounded(found.table(found.fit(_openplay(spark, sf))))


#: Sizes of the registered searches whose scans grow with trees and epochs; see the README.
BOOSTED = {"n_iter": 10, "trees": 10}
NEURAL = {"epochs": 10}


@query("search_boosted")
def _(spark, sf):
    found = search.boosted_search(NUMERIC, CATEGORIC, scoring="brier", fold=FOLD, **BOOSTED)
    return rounded(found.table(found.fit(_openplay(spark, sf))))


@query("search_mlp")
def _(spark, sf):
    """100 draws and 5 folds."""
    found = search.mlp_search(NUMERIC, CATEGORIC, fold=FOLD, **NEURAL)
    return rounded(found.table(found.fit(_openplay(spark, sf))), 4)


def _prices(spark, sf):
    return adapter.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("label"),
    )




LINE = {"key": ("l_orderkey", "l_linenumber")}


def _line_search():
    fold = "int((l_orderkey * 7 + l_linenumber) % 5)"
    return search.linear_regression_search(["l_quantity", "l_discount"], ["l_returnflag"], fold=fold, **LINE)


def _line_sql(draws):
    """Normal equations for l2, rounds of coordinate descent for l1."""
    columns = ["one", "fa", "fn", "fr", "q", "d"]
    n = len(columns)
    rows = [(i, d["alpha"], d["penalty"] == "l1", search.parameter_text(d)) for i, d in enumerate(draws)]
    sums = [f"avg({a} * {b}) as m{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate([*columns, "y"])]
    ridge = [f"m{i}_{j}" + (" + alpha" if i == j and i else "") + f" as m{i}_{j}" for i in range(n) for j in range(n + 1)]
    round_ = "cd"
    text = "select cd.k, cd.i, cd.alpha, cd.it, " + ", ".join([f"cd.w{i}" for i in range(n)] + [f"m{i}_{j}" for i in range(n) for j in range(n + 1)])
    text += f" from {round_} join gram on gram.k = cd.k where it < 400"
    for j in range(n):
        rest = f"m{j}_{n} - (" + " + ".join(f"m{j}_{i} * w{i}" for i in range(n) if i != j) + ")"
        new = f"({rest}) / m{j}_{j}" if j == 0 else f"sign({rest}) * greatest(abs({rest}) - alpha, 0) / m{j}_{j}"
        text = f"select * replace ({new} as w{j}) from ({text}) s{j}"
    names = ", ".join(f"w{i}" for i in range(n))
    fitted = " + ".join(f"w{i} * {c}" for i, c in enumerate(columns))
    return f"""with recursive lv as (
  select (l_orderkey * 7 + l_linenumber) % 5 as f, l_extendedprice / 1000 as y, l_quantity, l_discount, l_returnflag from lineitem),
lm as (select k, avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_discount) as md, stddev_pop(l_discount) as sd
  from lv, range(5) r(k) where f <> k group by k),
lz as (select k, f, y, 1.0e0 as one, case l_returnflag when 'A' then 1.0e0 else 0.0e0 end as fa,
  case l_returnflag when 'N' then 1.0e0 else 0.0e0 end as fn, case l_returnflag when 'R' then 1.0e0 else 0.0e0 end as fr,
  (l_quantity - mq) / sq as q, (l_discount - md) / sd as d from lv, lm),
cand as (select * from (values {_values(rows)}) t(i, alpha, l1, parameters)),
gram as (select k, {", ".join(sums)} from lz where f <> k group by k),
cd as (
  select k, i, cast(alpha as double) as alpha, 0 as it, {", ".join(f"0.0e0 as w{i}" for i in range(n))} from cand, range(5) r(k) where l1
  union all
  select k, i, alpha, it + 1, {names} from ({text}) s),
ridge as ({elimination(f"select k, i, {', '.join(ridge)} from gram, cand where not l1", "k, i", n)}),
w as (select k, i, {names} from cd where it = 400
  union all select k, i, {", ".join(f"b{i} as w{i}" for i in range(n))} from ridge),
per as (select lz.k, i, sqrt(avg(pow({fitted} - y, 2))) as s from lz join w on lz.k = w.k where f = lz.k group by lz.k, i)
select cast(i as integer) as draw, parameters, round(avg(s), 4) as score from per join cand using (i) group by i, parameters"""


@query("regress_linear", _line_sql(_line_search().draws))
def _(spark, sf):
    """100 draws and 5 folds from one scan."""
    found = _line_search()
    return rounded(found.table(found.fit(_prices(spark, sf))), 4)


@query("regress_boosted")
def _(spark, sf):
    found = search.boosted_regression_search(
        ["l_quantity", "l_discount"], ["l_returnflag"], fold="int((l_orderkey * 7 + l_linenumber) % 5)", **LINE, **BOOSTED
    )
    return rounded(found.table(found.fit(_prices(spark, sf))), 4)


@query("regress_mlp")
def _(spark, sf):
    found = search.mlp_regression_search(
        ["l_quantity", "l_discount"], ["l_returnflag"], fold="int((l_orderkey * 7 + l_linenumber) % 5)", n_iter=10, **LINE, **NEURAL
    )
    return rounded(found.table(found.fit(_prices(spark, sf))), 4)


def _scorer_rows(spark, sf):
    p = F.col("p")
    return adapter.scored(spark, sf).select(
        F.col("y").cast("double").alias("label"), array_to_vector(F.array(1 - p, p)).alias("probability")
    )


@query(
    "score_auc",
    sql(
        """with counts as (select p, sum(y) as pos, sum(1 - y) as neg from scored group by p)
select round(sum(neg * (tp - pos / 2.0e0)) / max(np * nn), 6) as roc_auc from (
  select pos, neg, cast(sum(pos) over (order by p desc) as double) as tp,
         cast(sum(pos) over () as double) as np, cast(sum(neg) over () as double) as nn from counts) t""",
        "scored",
    ),
)
def _(spark, sf):
    """The scorer of the searches on the deterministic scores."""
    value = search.scorer("roc_auc").evaluate(_scorer_rows(spark, sf))
    return rounded(spark.createDataFrame([(value,)], "roc_auc double"))


@query("score_brier", sql("select round(avg((p - y) * (p - y)), 6) as brier from scored", "scored"))
def _(spark, sf):
    value = search.scorer("brier").evaluate(_scorer_rows(spark, sf))
    return rounded(spark.createDataFrame([(value,)], "brier double"))


@query("best_to_model", _best_sql(_logreg_search().draws))
def _(spark, sf):
    """The best model of a search as a shot model: validated, stored, loaded and applied."""
    data = adapter.data(spark, sf)
    fitted = _logreg_search().fit(_openplay(spark, sf))
    model = models.OpenplayModel.from_pipeline(fitted.bestModel, [("EUROPE", "1718")])
    scalars, _curve = model.validate(_openplay(spark, sf).withColumn("goal", F.col("goal").cast("int")))
    folder = scratch_path(spark, "models")
    model.save(spark, folder, "best")
    scored = models.ShotModel.load(spark, folder, "best").estimate(data)
    return rounded(scored, 3).withColumn("brier", F.lit(round(scalars["brier"], 5)))


@query("tree_lr")
def _(spark, sf):
    train, _val, test = _split(spark, sf)
    forest = Pipeline(stages=[prep.prep_tree(NUMERIC, CATEGORIC), search.BoostedTrees(maxIter=5, maxDepth=3)])
    model = treelr.TreeLR(forest).fit(train)
    return rounded(model.transform(test).select(*KEY, models.positive_probability().alias("xG")))


# --- calibration ------------------------------------------------------------------------


@query("calib_none", sql("select game_id, action_id, round(p, 6) as p from scored", "scored"))
def _(spark, sf):
    scored = adapter.scored(spark, sf).withColumnRenamed("p", "score")
    return rounded(calibrate.Calibrator(None).fit(scored).transform(scored).select(*KEY, "p"))


CLIPPED = """c as (select least(greatest(p, 1e-12), 1 - 1e-12) as p, p as s, cast(y as double) as y from scored),
x as (select 1.0e0 as w, 1.0e0 as one, y, s, ln(p) as lp, -ln(1 - p) as lq, ln(p) - ln(1 - p) as lo,
             ln(2 * p) as hp, -ln(2 * (1 - p)) as hq from c)"""


@query(
    "calib_parameters",
    sql(
        f"""select 'sigmoid' as method, a, b, c from (
  with {CLIPPED}, {newton("x", ["s", "one"], [0, 0])} select round(b0, 3) as a, 0.0e0 as b, round(b1, 3) as c from fitted) t1
union all select 'beta_am', a, a, c from (
  with {CLIPPED}, {newton("x", ["lo", "one"], [0, 0])} select round(greatest(b0, 0), 3) as a,
    -- with the slope at its bound, the intercept alone is fitted
    round(case when b0 > 0 then b1 else (select ln(avg(y) / (1 - avg(y))) from scored) end, 3) as c from fitted) t2""",
        "scored",
    ),
)
def _(spark, sf):
    """Fitted parameters on the deterministic scores."""
    scored = adapter.scored(spark, sf)
    a, c = calibrate.Calibrator("sigmoid").fit(scored, "p").parameters
    rows = [("sigmoid", a, 0.0, c), ("beta_am", *calibrate.Calibrator("beta_am").fit(scored, "p").parameters)]
    return rounded(spark.createDataFrame(rows, "method string, a double, b double, c double"), 3)


@query(
    "calib_isotonic_scores",
    sql(
        """with v as (select p, avg(y) as m, count(*) as n, row_number() over (order by p) as i from scored group by p),
spans as (
  select j.i as j, k.i as k, sum(k.m * k.n) over w / sum(k.n) over w as mean
  from v j join v k on j.i <= k.i window w as (partition by j.i order by k.i)),
lowest as (select j, k as i, min(mean) over (partition by j order by k desc) as low from spans),
levels as (select i, max(low) as q from lowest group by i)
select game_id, action_id, round(q, 6) as q from scored join v on v.p = scored.p join levels on levels.i = v.i""",
        "scored",
    ),
)
def _(spark, sf):
    """Monotone fit on the deterministic scores; the SQL uses the max-min formula."""
    scored = adapter.scored(spark, sf)
    out = calibrate.Calibrator("isotonic").fit(scored, "p").transform(scored, "p", "q")
    return rounded(out.select(*KEY, "q"))


# scores that fall with the distance in whole metres, so that there is something to calibrate
DISTANCE_SCORES = """ds as (
  select a.game_id, action_id, season_id, 1 / (1 + exp((floor(sqrt(pow(105 - start_x, 2) + pow(34 - start_y, 2))) - 15) / 8)) as p,
         case when result_name = 'success' then 1.0e0 else 0.0e0 end as y, case when bodypart_name = 'head' then 2.0e0 else 1.0e0 end as w
  from actions a join games g on a.game_id = g.game_id where type_name = 'shot' and result_name in ('success', 'fail'))"""


def _distance_scores(spark, sf):
    dx, dy = F.lit(105.0) - F.col("start_x"), F.lit(34.0) - F.col("start_y")
    metres = F.floor(F.sqrt(dx * dx + dy * dy))
    shots = adapter.actions(spark, sf).filter("type_name = 'shot' and result_name in ('success', 'fail')")
    return shots.join(adapter.games(spark, sf).select("game_id", "season_id"), "game_id").select(
        *KEY, "season_id", (1.0 / (1.0 + F.exp((metres - 15.0) / 8.0))).alias("score"),
        (F.col("result_name") == "success").cast("int").alias("y"),
        F.when(F.col("bodypart_name") == "head", 2.0).otherwise(1.0).alias("w"),
    )


# inputs of the logistic fit of each method, and which of them a bound at zero could hold
INPUTS = {
    "sigmoid": ["p", "1.0e0"],
    "beta": ["ln(p)", "-ln(1 - p)", "1.0e0"],
    "beta_am": ["ln(p) - ln(1 - p)", "1.0e0"],
    "beta_ab": ["ln(2 * p)", "-ln(2 * (1 - p))"],
}


# inputs whose weights are held at zero or above
BOUNDED = {"beta": (0, 1), "beta_ab": (0, 1)}


def _bounded_fit(rows, names, bounded):
    """View ``fitted``: weights of the inputs ``names``, those at ``bounded`` at zero or above. The
    best of the fits with all inputs and without some of the bounded ones, of those that keep
    the bounds."""
    views, fits = [], []
    for k in range(len(bounded) + 1):
        for left_out in combinations(bounded, k):
            used = [n for i, n in enumerate(names) if i not in left_out]
            own = [f"b{used.index(n)}" if n in used else "0.0e0" for n in names]
            held = " and ".join(f"{own[i]} >= 0" for i in bounded)
            columns = ", ".join(f"{x} as b{i}" for i, x in enumerate(own))
            if not used:
                fits.append(f"select {columns}")
                continue
            prefix = "f" + "".join(map(str, left_out)) + "_"
            views.append(newton(rows, used, [0] * len(used), steps=12, prefix=prefix))
            fits.append(f"select {columns} from {prefix}fitted where {held}")
    all_b = ", ".join(f"b{i}" for i in range(len(names)))
    score = " + ".join(f"b{i} * {n}" for i, n in enumerate(names))
    likelihood = f"sum(w * (y * -ln(1 + exp(-({score}))) + (1 - y) * -ln(1 + exp({score}))))"
    return ",\n".join(views) + f""",
fits as ({" union all ".join(fits)}),
fitted as (select {all_b} from fits, {rows} group by {all_b} order by {likelihood} desc limit 1)"""


def _calibration_sql(method, weight="1.0e0"):
    """Fit on one season by Newton steps, apply to the other."""
    names = [f"x{i}" for i in range(len(INPUTS[method]))]
    inputs = ", ".join(f"{x} as {n}" for x, n in zip(INPUTS[method], names))
    score = " + ".join(f"b{i} * {n}" for i, n in enumerate(names))
    bounded = BOUNDED.get(method)
    fit = _bounded_fit("tr", names, bounded) if bounded else newton("tr", names, [0] * len(names), steps=12)
    return sql(f"""with {DISTANCE_SCORES},
x as (select game_id, action_id, season_id, y, {weight} as w, {inputs} from ds),
tr as (select * from x where season_id = '1718'),
{fit}
select game_id, action_id, round(1 / (1 + exp(-({score}))), 3) as p from x, fitted where season_id = '1819'""")


def _calibration(method, weight=None):
    def run(spark, sf):
        scores = _distance_scores(spark, sf)
        train = materialize(scores.filter("season_id = '1718'"), "scores")
        fitted = calibrate.Calibrator(method).fit(train, weight=weight)
        out = fitted.transform(scores.filter("season_id = '1819'"))
        return rounded(out.select(*KEY, "p"), 3)

    return run


for _method in INPUTS:
    query(f"calib_{_method}", _calibration_sql(_method))(_calibration(_method))
query("calib_weights", _calibration_sql("beta_am", "w"))(_calibration("beta_am", "w"))


@query(
    "calib_isotonic",
    sql(
        f"""with {DISTANCE_SCORES},
v as (select p, avg(y) as m, count(*) as n, row_number() over (order by p) as i from ds group by p),
spans as (
  select j.i as j, k.i as k, sum(k.m * k.n) over w / sum(k.n) over w as mean
  from v j join v k on j.i <= k.i window w as (partition by j.i order by k.i)),
lowest as (select j, k as i, min(mean) over (partition by j order by k desc) as low from spans),
levels as (select i, max(low) as q from lowest group by i)
select game_id, action_id, round(q, 6) as p from ds join v on v.p = ds.p join levels on levels.i = v.i"""
    ),
)
def _(spark, sf):
    """Monotone fit; the SQL uses the max-min formula."""
    scores = _distance_scores(spark, sf)
    return rounded(calibrate.Calibrator("isotonic").fit(scores).transform(scores).select(*KEY, "p"))


SPLIT_COLUMNS = ["foot", "head", "other", "x", "y0", "d", "sa"]


def _split_sql(weight="1.0e0"):
    """Views ``val`` and ``test`` with the margin ``m`` and the probability ``pr`` of the logistic
    model, fitted on the earliest half of the games; numbers are scaled as in that half."""
    scaled = ", ".join(f"(({c} - avg_{c}) / sd_{c}) as {c}" for c in SPLIT_COLUMNS[3:])
    stats = ", ".join(f"avg({c}) as avg_{c}, stddev_pop({c}) as sd_{c}" for c in SPLIT_COLUMNS[3:])
    n = len(SPLIT_COLUMNS)
    margin = " + ".join(f"b{i} * {c}" for i, c in enumerate(SPLIT_COLUMNS)) + f" + b{n}"
    return f"""numbered as (
  select game_id, row_number() over (order by game_date, game_id) - 1 as pos, count(*) over () as n from games),
parts as (
  select game_id, case when pos < floor(0.5e0 * n + 1e-9) then 'train' when pos < floor(0.7e0 * n + 1e-9) then 'val' else 'test' end as split
  from numbered),
shots as (
  select game_id, action_id, split, y, {weight} as w, 1.0e0 as one, x, y0, pow(105 - x, 2) + pow(34 - y0, 2) as d2,
         case when bodypart_name = 'foot' then 1.0e0 else 0.0e0 end as foot,
         case when bodypart_name = 'head' then 1.0e0 else 0.0e0 end as head,
         case when bodypart_name = 'other' then 1.0e0 else 0.0e0 end as other
  from (select a.game_id, action_id, split, bodypart_name, case when result_name = 'success' then 1.0e0 else 0.0e0 end as y,
               case when team_id <> home_team_id then 105 - start_x else start_x end as x,
               case when team_id <> home_team_id then 68 - start_y else start_y end as y0
        from actions a join games g on a.game_id = g.game_id join parts p on p.game_id = a.game_id where {OPENPLAY}) t),
raw as (
  select *, sqrt(d2) as d, case when x = 105 and y0 between 30.35e0 and 37.65e0 then pi() when x = 105 then 0.0e0
    else atan(7.3e0 * (105 - x) / (d2 - 13.3225e0)) + case when d2 < 13.3225e0 then pi() else 0.0e0 end end as sa from shots),
st as (select {stats} from raw where split = 'train'),
z as (select game_id, action_id, split, y, w, one, foot, head, other, {scaled} from raw, st),
trained as (select * from z where split = 'train'),
{newton("trained", [*SPLIT_COLUMNS, "one"], [1] * n + [0], prefix="m_")},
margins as (select z.*, {margin} as m from z, m_fitted),
scored as (select game_id, action_id, split, y, w, one, m, 1 / (1 + exp(-m)) as pr, ln(1 + exp(m)) as nq, ln(1 + exp(-m)) as np from margins),
val as (select * from scored where split = 'val'),
test as (select * from scored where split = 'test')"""


@query(
    "calib_prefit",
    sql(f"""with {_split_sql()},
{newton("val", ["m", "one"], [0, 0], steps=12, prefix="r_")},
{newton("val", ["pr", "one"], [0, 0], steps=12, prefix="q_")}
select game_id, action_id, 'rawPrediction' as score, round(1 / (1 + exp(-(b0 * m + b1))), 3) as p from test, r_fitted
union all select game_id, action_id, 'probability', round(1 / (1 + exp(-(b0 * pr + b1))), 3) from test, q_fitted"""),
)
def _(spark, sf):
    """The same method on the margin and on the probability of the model."""
    train, val, test = _split(spark, sf)
    model = _logistic().fit(train)
    parts = []
    for score in ("rawPrediction", "probability"):
        calibrated = calibrate.CalibratedClassifier(model, "sigmoid", score_type=score).fit(val)
        parts.append(calibrated.predict_proba(test).select(*KEY, F.lit(score).alias("score"), F.col("proba")[1].alias("p")))
    return rounded(parts[0].unionByName(parts[1]), 3)


CV_COLUMNS = [*SPLIT_COLUMNS, "one"]
CV_MARGIN = " + ".join(f"b{i} * {c}" for i, c in enumerate(CV_COLUMNS))


@query(
    "calib_cv",
    sql(f"""with {_split_sql()},
cr as (select *, (game_id * 31 + action_id) % 3 as f from raw),
cm as (select k, {", ".join(f"avg({c}) as avg_{c}, stddev_pop({c}) as sd_{c}" for c in SPLIT_COLUMNS[3:])}
  from cr, range(3) r(k) where split = 'train' and f <> k group by k),
cz as (select k, game_id, action_id, split, f, y, one, foot, head, other, {", ".join(f"(({c} - avg_{c}) / sd_{c}) as {c}" for c in SPLIT_COLUMNS[3:])}
  from cr, cm),
ct as (select * from cz where split = 'train'),
unit as (select 0 as i, 1.0e0 as strength, false as balanced),
{newton_grid("ct", CV_COLUMNS, "unit", 12, ["one"], "f_")},
cs as (select cz.*, {CV_MARGIN} as m from cz join f_grid on f_grid.k = cz.k),
-- the calibrator of a fold sees the rows of the fold only
cc as (select k, -1 as f, y, m, one from cs where split = 'train' and f = k),
none as (select 0 as i, 0.0e0 as strength, false as balanced),
{newton_grid("cc", ["m", "one"], "none", 12, ["m", "one"], "c_")}
select game_id, action_id, round(avg(1 / (1 + exp(-(b0 * m + b1)))), 3) as p from cs join c_grid on c_grid.k = cs.k
where split = 'test' group by game_id, action_id"""),
)
def _(spark, sf):
    """Three folds: models fitted together, each calibrated on its own fold, predictions averaged."""
    train, _val, test = _split(spark, sf)
    calibrated = calibrate.CalibratedClassifier(_logistic(), "sigmoid", folds=3, fold="int((game_id * 31 + action_id) % 3)").fit(train)
    return rounded(calibrated.predict_proba(test).select(*KEY, F.col("proba")[1].alias("p")), 3)


@query(
    "calib_scores",
    sql(
        """select game_id, action_id, round(1 / (1 + exp(-(3.5e0 * p - 2.25e0))), 6) as sigmoid,
       case when p = 0 then 0.0e0 else
         round(1 / (1 + exp(-(1.5e0 * ln(p) - 0.5e0 * ln(1 - p) + 0.75e0))), 6) end as beta from scored""",
        "scored",
    ),
)
def _(spark, sf):
    """Calibrators with given parameters on bare scores."""
    scored = adapter.scored(spark, sf)
    out = calibrate.Calibrator("sigmoid", (3.5, -2.25)).transform(scored, "p", "sigmoid")
    out = calibrate.Calibrator("beta", (1.5, 0.5, 0.75)).transform(out, "p", "beta")
    return rounded(out.select(*KEY, "sigmoid", "beta"))


class _FirstEntries:
    """Stands for a fitted classifier of ten classes: probabilities from the first ten entries."""

    def transform(self, df):
        weights = F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(v.cast("double") * 4.0))
        total = F.aggregate("_w", F.lit(0.0), lambda s, w: s + w)
        return df.withColumn("_w", weights).withColumn("probability", array_to_vector(F.transform("_w", lambda w: w / total))).drop("_w")


def _multiclass(spark, sf):
    rows = adapter.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), "embedding")
    fitted = calibrate.CalibratedClassifier(_FirstEntries(), "isotonic", score_type="probability", key=("vec_id",)).fit(rows.filter("vec_id % 2 = 1"))
    return fitted, rows


#: A monotone fit per class on the odd rows by the max-min formula, read off between its points.
MULTICLASS = """w as (select vec_id, label, list_transform(list_slice(embedding, 1, 10), lambda v: exp(cast(v as double) * 4)) as w from embeddings),
sc as (select vec_id, label, c, w[c + 1] / list_sum(w) as s from w, range(10) r(c)),
v as (select c, s, avg(case when label = c then 1.0e0 else 0.0e0 end) as m, count(*) as n, row_number() over (partition by c order by s) as i
  from sc where vec_id % 2 = 1 group by c, s),
spans as (select j.c as c, j.i as j, k.i as k, sum(k.m * k.n) over w / sum(k.n) over w as mean
  from v j join v k on j.c = k.c and j.i <= k.i window w as (partition by j.c, j.i order by k.i)),
lowest as (select c, j, k as i, min(mean) over (partition by c, j order by k desc) as low from spans),
levels as (select c, i, max(low) as q from lowest group by c, i),
points as (select c, s as x, q from v join levels using (c, i)),
near as (select sc.*, a.x as ax, a.q as aq, b.x as bx, b.q as bq from sc
  asof left join points a on sc.c = a.c and sc.s >= a.x asof left join points b on sc.c = b.c and sc.s <= b.x),
one as (select vec_id, label, c, case when ax is null then bq when bx is null or ax = s then aq else aq + (bq - aq) * (s - ax) / (bx - ax) end as p
  from near),
proba as (select vec_id, label, c, coalesce(p / nullif(sum(p) over (partition by vec_id), 0), 0.1e0) as p from one)"""


@query("calib_multiclass", f"with {MULTICLASS} select vec_id, cast(c as integer) as class, round(p, 6) as p from proba")
def _(spark, sf):
    """Class probabilities of every vector, calibrated class by class."""
    fitted, rows = _multiclass(spark, sf)
    return rounded(fitted.predict_proba(rows).select("vec_id", F.posexplode("proba").alias("class", "p")))


@query(
    "calib_predict",
    f"""with {MULTICLASS}
select vec_id, cast(label as double) as label, cast(arg_min(c, (-round(p, 9), c)) as double) as prediction, round(max(p), 6) as p
from proba group by vec_id, label""",
)
def _(spark, sf):
    fitted, rows = _multiclass(spark, sf)
    return rounded(fitted.predict(rows).select("vec_id", "label", "prediction", F.array_max("proba").alias("p")))


@query(
    "calib_weighted_model",
    sql(f"""with {_split_sql("case when bodypart_name = 'head' then 2.0e0 else 1.0e0 end")},
v as (select y, w, -np as x0, nq as x1, one as x2 from val),
{_bounded_fit("v", ["x0", "x1", "x2"], (0, 1))}
select game_id, action_id, round(1 / (1 + exp(-(b0 * -np + b1 * nq + b2))), 3) as p from test, fitted"""),
)
def _(spark, sf):
    """Headers weigh twice, in the calibration as in the fit of the model."""
    train, val, test = _split(spark, sf)
    weighted = SQLTransformer(statement="SELECT *, CASE WHEN bodypart_id_a0 = 'head' THEN 2D ELSE 1D END AS w FROM __THIS__")
    base = Pipeline(stages=[weighted, prep.prep_linear(NUMERIC, CATEGORIC), models.SkLogistic(weightCol="w")]).fit(train)
    calibrated = calibrate.CalibratedClassifier(base, "beta", weight="w").fit(val)
    return rounded(calibrated.predict_proba(test).select(*KEY, F.col("proba")[1].alias("p")), 3)


@query("calib_compare")
def _(spark, sf):
    train, val, test = _split(spark, sf)
    return rounded(calibrate.compare(_logistic().fit(train), val, test))
