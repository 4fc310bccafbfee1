"""Actions, game states, feature generators, shot selection."""

from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions import filters
from shotspark.functions.filters import field_of
from shotspark.functions.vocab import Vocabulary
from shotspark.operators import actions as ops
from shotspark.plans import dataset
from shotspark.scale import hot_keys, scratch_path
from shotspark.sources import store, tables
from shotspark.sources.tables import ShotData
from workload import adapter
from workload.adapter import sql
from workload.catalog import query, rounded

KEY = ["game_id", "action_id"]


# --- preparation ------------------------------------------------------------------------


@query("enhance_actions", sql("select game_id, action_id, type_name, result_name, bodypart_name from actions"))
def _(spark, sf):
    return ops.enhance(adapter.data(spark, sf).actions).select(*KEY, "type_name", "result_name", "bodypart_name")


@query(
    "flip_actions",
    sql("""select a.game_id, action_id,
       round(case when team_id <> home_team_id then 105 - start_x else start_x end, 6) as start_x,
       round(case when team_id <> home_team_id then 68 - start_y else start_y end, 6) as start_y,
       round(case when team_id <> home_team_id then 105 - end_x else end_x end, 6) as end_x,
       round(case when team_id <> home_team_id then 68 - end_y else end_y end, 6) as end_y
from actions a join games g on a.game_id = g.game_id"""),
)
def _(spark, sf):
    d = adapter.data(spark, sf)
    flipped = ops.play_left_to_right(d.actions, d.games)
    return rounded(flipped.select(*KEY, "start_x", "start_y", "end_x", "end_y"))


STATES_SQL = sql(
    """select game_id, action_id, a1.action_id as action_id_a1, a2.action_id as action_id_a2,
       a1.type_name as type_name_a1, a2.start_x as start_x_a2 from lagged""",
    "lagged",
)


def _states(spark, sf, hot):
    named = ops.enhance(adapter.data(spark, sf).actions)
    states = ops.gamestates(named, 3, hot)
    types = Vocabulary().types
    return states.select(
        *KEY,
        F.col("a1.action_id").alias("action_id_a1"),
        F.col("a2.action_id").alias("action_id_a2"),
        F.get(F.array(*[F.lit(t) for t in types]), F.col("a1.type_id").cast("int")).alias("type_name_a1"),
        F.col("a2.start_x").alias("start_x_a2"),
    )


@query("game_states", STATES_SQL)
def _(spark, sf):
    return _states(spark, sf, adapter.hot_games(spark, sf))


@query("game_states_hot", STATES_SQL)
def _(spark, sf):
    """The way taken for games too large for one task, here forced for the largest games."""
    events = adapter.table(spark, sf, "events").select(F.col("user_id").alias("game_id"))
    return _states(spark, sf, hot_keys(events, ["game_id"], 70))


@query(
    "flip_states",
    sql(
        """select game_id, action_id,
       round(case when away then 105 - a0.start_x else a0.start_x end, 6) as start_x_a0,
       round(case when away then 105 - a1.start_x else a1.start_x end, 6) as start_x_a1,
       round(case when away then 68 - a2.end_y else a2.end_y end, 6) as end_y_a2
from (select *, a0.team_id <> home_team_id as away from lagged) t""",
        "lagged",
    ),
)
def _(spark, sf):
    d = adapter.data(spark, sf)
    states = ops.flip_states(ops.gamestates(ops.with_home(d.actions, d.games), 3, d.hot))
    return rounded(
        states.select(
            *KEY,
            F.col("a0.start_x").alias("start_x_a0"),
            F.col("a1.start_x").alias("start_x_a1"),
            F.col("a2.end_y").alias("end_y_a2"),
        )
    )


for _name, _filter, _where in [
    ("filter_default", filters.any_shot,
     "type_name in ('shot', 'shot_penalty', 'shot_freekick') and result_name in ('fail', 'success')"),
    ("filter_openplay", filters.openplay, "type_name = 'shot' and result_name in ('fail', 'success')"),
    ("filter_penalty", filters.penalty, "type_name = 'shot_penalty'"),
    ("filter_freekick", filters.freekick, "type_name = 'shot_freekick'"),
]:

    @query(_name, sql(f"select game_id, action_id, type_name, result_name from actions where {_where}"))
    def _(spark, sf, shot_filter=_filter):
        named = ops.enhance(adapter.data(spark, sf).actions)
        return named.filter(shot_filter(field_of())).select(*KEY, "type_name", "result_name")


@query(
    "mask_postshot",
    sql(
        """select game_id, action_id, a0.end_x as end_x_a0, a0.end_y as end_y_a0,
       a0.result_name as result_a0, a1.result_name as result_a1, round(a1.end_x, 6) as end_x_a1 from states""",
        "states",
    ),
)
def _(spark, sf):
    states = dataset.shot_states(adapter.data(spark, sf))
    results = F.array(*[F.lit(r) for r in Vocabulary().results])
    return rounded(
        states.select(
            *KEY,
            F.col("a0.end_x").alias("end_x_a0"),
            F.col("a0.end_y").alias("end_y_a0"),
            F.get(results, F.col("a0.result_id").cast("int")).alias("result_a0"),
            F.get(results, F.col("a1.result_id").cast("int")).alias("result_a1"),
            F.col("a1.end_x").alias("end_x_a1"),
        )
    )


@query(
    "decode_categories",
    sql("""select game_id, action_id, case when type_name in ('pass', 'cross', 'shot') then type_name end as type_id_a0,
       result_name as result_id_a0, bodypart_name as bodypart_id_a0 from actions"""),
)
def _(spark, sf):
    """Ids to names; here the vocabulary is cut, so some ids lie outside of it."""
    vocab = Vocabulary(types=["pass", "cross", "dribble", "tackle", "shot"])
    ids = fs.on_table(adapter.data(spark, sf).actions, [fs.actiontype, fs.bodypart, fs.result], KEY)
    types = F.col("type_id_a0")
    return ops.decode_categories(ids.withColumn("type_id_a0", F.when(~types.isin(2, 3), types)), vocab)


# --- generators -------------------------------------------------------------------------


def per_state(template):
    """SQL of a per-action generator: {s} is the state, {i} its number."""
    return ", ".join(template.format(s=f"a{i}", i=i) for i in range(3))


def earlier(template):
    return ", ".join(template.format(s=f"a{i}", i=i) for i in (1, 2))


def polar(kind):
    dx, dy = "(105 - {s}.%s_x)" % kind, "abs(34 - {s}.%s_y)" % kind
    return per_state(
        f"round(sqrt({dx} * {dx} + {dy} * {dy}), 6) as {kind}_dist_to_goal_a{{i}}, "
        f"round(case when {dx} = 0 then case when {dy} > 0 then pi() / 2 when {dy} = 0 then 0.0e0 end "
        f"else atan({dy} / {dx}) end, 6) as {kind}_angle_to_goal_a{{i}}"
    )


GOAL_ANGLE = """round(case when {s}.start_x = 105 and {s}.start_y between 30.35e0 and 37.65e0 then pi()
  when {s}.start_x >= 105 then 0.0e0
  else (case when atan(7.3e0 * (105 - {s}.start_x) / (pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2) - 13.3225e0)) < 0
        then pi() else 0.0e0 end)
       + atan(7.3e0 * (105 - {s}.start_x) / (pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2) - 13.3225e0)) end, 6)
  as shot_angle_a{i}"""

# zones from the last one down, in metres from the goal line (near, far) and across (low, high)
ZONES = [
    (8, [(0, 32, 0, 13.85)]),
    (7, [(32, 105, 0, 68)]),
    (6, [(16.5, 32, 13.85, 54.15)]),
    (5, [(0, 7.5, 13.85, 24.85), (0, 7.5, 43.15, 54.15)]),
    (4, [(7.5, 16.5, 13.85, 24.85), (7.5, 16.5, 43.15, 54.15)]),
    (3, [(5.5, 16.5, 24.85, 43.15)]),
    (2, [(0, 5.5, 24.85, 30.35), (0, 5.5, 37.65, 43.15)]),
    (1, [(0, 5.5, 30.35, 37.65)]),
]


def zone_case(x, y, zones):
    whens = " ".join(
        "when "
        + " or ".join(
            f"({x} between {105 - far}e0 and {105 - near}e0 and {y} between {low}e0 and {high}e0)"
            for near, far, low, high in parts
        )
        + f" then {number}"
        for number, parts in zones
    )
    return f"case {whens} else 0 end"


def digitize(value, edges):
    return "(" + " + ".join(f"(case when {value} >= {e}e0 then 1 else 0 end)" for e in edges) + ")"


def grid_case(a, b, size):
    return f"case when {a} * {b} + {a} between 0 and {size - 1} then {a} * {b} + {a} end"


_dist = "sqrt(pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2))"
# every angle lies between -20 and 20
ANGLE_ZONE = grid_case(digitize(_dist, fs.DISTANCE_EDGES), "2", 32) + " as angle_zone_a{i}"
_folded = "(case when {s}.start_y > 34 then {s}.start_y - 34 else {s}.start_y end)"
X_EDGES, Y_EDGES = [0, 20, 40, 60, 80, 95], [0, 10, 20, 30]
RECTANGLE = (
    f"case when {digitize('{s}.start_x', X_EDGES)} * {digitize(_folded, Y_EDGES)} + {digitize(_folded, Y_EDGES)} "
    f"between 0 and 23 then {digitize('{s}.start_x', X_EDGES)} * {digitize(_folded, Y_EDGES)} + "
    f"{digitize(_folded, Y_EDGES)} end as grid_zone_a{{i}}"
)

_delta = "({s}.end_x - a0.start_x)", "({s}.end_y - a0.start_y)"
_dt = "greatest(a0.time_seconds - {s}.time_seconds, 1.0e0)"
_way = "sqrt({0} * {0} + {1} * {1})".format(*_delta)

GENERATORS = {
    "feat_actiontype": ([fs.actiontype], per_state("{s}.type_name as type_id_a{i}")),
    "feat_bodypart": ([fs.bodypart], per_state("{s}.bodypart_name as bodypart_id_a{i}")),
    "feat_result": ([fs.result], per_state("{s}.result_name as result_id_a{i}")),
    "feat_startlocation": (
        [fs.startlocation],
        per_state("round({s}.start_x, 6) as start_x_a{i}, round({s}.start_y, 6) as start_y_a{i}"),
    ),
    "feat_endlocation": (
        [fs.endlocation],
        per_state("round({s}.end_x, 6) as end_x_a{i}, round({s}.end_y, 6) as end_y_a{i}"),
    ),
    "feat_movement": (
        [fs.movement],
        per_state(
            "round({s}.end_x - {s}.start_x, 6) as dx_a{i}, round({s}.end_y - {s}.start_y, 6) as dy_a{i}, "
            "round(sqrt(pow({s}.end_x - {s}.start_x, 2) + pow({s}.end_y - {s}.start_y, 2)), 6) as movement_a{i}"
        ),
    ),
    "feat_space_delta": (
        [fs.space_delta],
        earlier(f"round({_delta[0]}, 6) as dx_a0{{i}}, round({_delta[1]}, 6) as dy_a0{{i}}, round({_way}, 6) as mov_a0{{i}}"),
    ),
    "feat_startpolar": ([fs.startpolar], polar("start")),
    "feat_endpolar": ([fs.endpolar], polar("end")),
    "feat_team": ([fs.team], earlier("{s}.team_id = a0.team_id as team_{i}")),
    "feat_time_delta": (
        [fs.time_delta],
        earlier("round(a0.time_seconds - {s}.time_seconds, 6) as time_delta_{i}"),
    ),
    "feat_speed": (
        [fs.speed],
        earlier(
            f"round(abs({_delta[0]}) / {_dt}, 6) as speedx_a0{{i}}, round(abs({_delta[1]}) / {_dt}, 6) as speedy_a0{{i}}, "
            f"round({_way} / {_dt}, 6) as speed_a0{{i}}"
        ),
    ),
    "feat_goalangle": ([fs.goalangle], per_state(GOAL_ANGLE)),
    "feat_caley_zone": (
        [fs.location_zone],
        per_state(zone_case("{s}.start_x", "{s}.start_y", ZONES) + " as caley_zone_a{i}"),
    ),
    "feat_triangular_grid": (
        [fs.triangular_grid("angle_zone", fs.ANGLE_EDGES, fs.DISTANCE_EDGES, symmetrical=True)],
        per_state(ANGLE_ZONE),
    ),
    "feat_rectangular_grid": (
        [fs.rectangular_grid("grid_zone", X_EDGES, Y_EDGES, symmetrical=True)],
        per_state(RECTANGLE),
    ),
    "feat_custom_grid": (
        [
            fs.custom_grid(
                "ring",
                [[60], [30], [15]],
                lambda radius: lambda x, y: (105 - x) * (105 - x) + (34 - y) * (34 - y) <= radius * radius,
            )
        ],
        per_state(
            "case when pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2) <= 225 then 3 "
            "when pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2) <= 900 then 2 "
            "when pow(105 - {s}.start_x, 2) + pow(34 - {s}.start_y, 2) <= 3600 then 1 else 0 end as ring_a{i}"
        ),
    ),
}

for _name, (_generators, _columns) in GENERATORS.items():

    @query(_name, sql(f"select game_id, action_id, {_columns} from states", "states"))
    def _(spark, sf, generators=_generators):
        return rounded(dataset.shot_features(adapter.data(spark, sf), generators))


ALL_NAMES = [n for n in GENERATORS if n not in ("feat_rectangular_grid", "feat_custom_grid")]
ALL_COLUMNS = ", ".join(GENERATORS[n][1] for n in ALL_NAMES)
ALL_SQL = sql(f"select game_id, action_id, {ALL_COLUMNS} from states", "states")


@query("all_features", ALL_SQL)
def _(spark, sf):
    return rounded(dataset.shot_features(adapter.data(spark, sf)))


@query(
    "lift_simple",
    sql("""select game_id, action_id, round(start_x, 6) as start_x_a0, round(start_y, 6) as start_y_a0,
       round(end_x - start_x, 6) as forward_a0 from actions"""),
)
def _(spark, sf):
    """Generators, one of them the user's own, on a plain action table."""

    @fs.simple
    def forward(a):
        return {"forward": a("end_x") - a("start_x")}

    return rounded(fs.on_table(adapter.data(spark, sf).actions, [fs.startlocation, forward], KEY))


# --- feature and label tables -----------------------------------------------------------

_MASKED = "end_x_a0 end_y_a0 dx_a0 dy_a0 movement_a0 end_dist_to_goal_a0 end_angle_to_goal_a0 result_id_a0".split()


@query(
    "drop_constant",
    sql(f"select * exclude ({', '.join(_MASKED)}) from (select game_id, action_id, {ALL_COLUMNS} from states) t", "states"),
)
def _(spark, sf):
    return rounded(ops.drop_constant(dataset.shot_features(adapter.data(spark, sf))))


@query(
    "shot_features",
    sql(
        """select game_id, action_id, {} from states where shot_type = 'shot'""".format(
            ", ".join(GENERATORS[n][1] for n in ("feat_startpolar", "feat_bodypart", "feat_goalangle", "feat_speed"))
        ),
        "states",
    ),
)
def _(spark, sf):
    generators = [fs.startpolar, fs.bodypart, fs.goalangle, fs.speed]
    return rounded(dataset.shot_features(adapter.data(spark, sf), generators, filters.openplay))


@query("shot_keys", sql("select game_id, action_id from actions where type_name = 'shot_penalty'"))
def _(spark, sf):
    """Without generators only the keys of the shots are left."""
    return dataset.shot_features(adapter.data(spark, sf), [], filters.penalty)


@query("shot_labels", sql("select game_id, action_id, result_name = 'success' as goal from states", "states"))
def _(spark, sf):
    return dataset.shot_labels(adapter.data(spark, sf))


@query(
    "training_frame",
    sql(f"select game_id, action_id, result_name = 'success' as goal, {polar('start')} from states", "states"),
)
def _(spark, sf):
    return rounded(dataset.training_frame(adapter.data(spark, sf), [fs.startpolar]))


@query(
    "select_games",
    sql("""select game_id, competition_id, season_id from games
where (competition_id, season_id) in (('ASIA', '1718'), ('EUROPE', '1819'))"""),
)
def _(spark, sf):
    games = tables.select_games(adapter.games(spark, sf), [("ASIA", 1718), ("EUROPE", "1819")])
    return games.select("game_id", "competition_id", "season_id")


SPLIT_SQL = """select game_id, split from (
  select game_id, case when pos < floor(0.5e0 * n + 1e-9) then 'train' when pos < floor(0.7e0 * n + 1e-9) then 'val' else 'test' end as split
  from (select game_id, row_number() over (order by game_date, game_id) - 1 as pos, count(*) over () as n from games) t) u"""


@query("split_temporal", sql(SPLIT_SQL))
def _(spark, sf):
    return tables.sample_temporal(adapter.games(spark, sf), 0.2, 0.3).select("game_id", "split")


@query(
    "shape_report",
    sql(
        f"""select split, count(*) as n_rows, 8 as n_columns from ({SPLIT_SQL}) s
join states on states.game_id = s.game_id group by split""",
        "states",
    ),
)
def _(spark, sf):
    from shotspark.operators.report import shapes

    d = adapter.data(spark, sf)
    split = tables.sample_temporal(d.games, 0.2, 0.3).select("game_id", "split")
    features = dataset.shot_features(d, [fs.startpolar]).join(split, "game_id")
    return shapes(features, "split", ignore=("split",)).withColumn("n_columns", F.col("n_columns").cast("int"))


@query(
    "openplay_subset",
    sql(f"select game_id, action_id, {per_state('{s}.type_name as type_id_a{i}')} from states where shot_type = 'shot'", "states"),
)
def _(spark, sf):
    return store.openplay_subset(dataset.shot_features(adapter.data(spark, sf), [fs.actiontype]))


@query(
    "feature_store",
    sql(
        f"""select s.game_id, action_id, competition_id, season_id, result_name = 'success' as goal, {polar('start')}
from states s join games g on s.game_id = g.game_id
where (competition_id, season_id) in (('ASIA', '1718'), ('EUROPE', '1819'))""".replace(
            "competition_id, season_id, result_name", "competition_id, replace(season_id, '1718', '0910') as season_id, result_name"
        ),
        "states",
    ),
)
def _(spark, sf):
    """Stored season by season, one of them under a name with a leading zero."""
    d = adapter.data(spark, sf)
    path = scratch_path(spark, "features")
    for season, name in (("1718", "0910"), ("1819", "1819")):
        games = d.games.filter(F.col("season_id") == season).withColumn("season_id", F.lit(name))
        part = ShotData(games=games, actions=d.actions, vocab=d.vocab, hot=d.hot)
        store.write_features(dataset.training_frame(part, [fs.startpolar]), games, path)
    return rounded(store.read_features(spark, path, [("ASIA", "0910"), ("EUROPE", "1819")]))


@query(
    "pitch_grid",
    sql("""select b.bodypart_name as bodypart_id_a0, cast(x as double) as start_x_a0, cast(y as double) as start_y_a0,
       round(sqrt(pow(105 - x, 2) + pow(34 - y, 2)), 6) as start_dist_to_goal_a0,
       round(case when x = 105 then case when y = 34 then 0.0e0 else pi() / 2 end
                  else atan(abs(34 - y) / cast(105 - x as double)) end, 6) as start_angle_to_goal_a0,
       round(case when x = 105 and y between 30.35e0 and 37.65e0 then pi() when x = 105 then 0.0e0
             else atan(7.3e0 * (105 - x) / (pow(105 - x, 2) + pow(34 - y, 2) - 13.3225e0))
                  + case when pow(105 - x, 2) + pow(34 - y, 2) < 13.3225e0 then pi() else 0.0e0 end end, 6) as shot_angle_a0
from (select distinct bodypart_name from actions) b, range(0, 106) t1(x), range(0, 69) t2(y)"""),
)
def _(spark, sf):
    bodyparts = adapter.actions(spark, sf).select(F.col("bodypart_name").alias("bodypart_id")).distinct()
    return rounded(dataset.pitch_grid(bodyparts))
