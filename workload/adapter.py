"""The shot data model derived from the test tables, as DataFrames and as SQL views."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.functions.vocab import BODYPARTS, RESULTS, TYPES, id_of
from shotspark.scale import hot_keys, number_rows
from shotspark.sources.tables import ShotData

HALF = 1705363200000000  # microseconds of the start of the second period
KICKOFF = 1704067200000000

_memo: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _once(spark, sf, f"table {name}", lambda: spark.read.parquet(f"{sf}/{name}.parquet"))


def _once(spark, sf, name, build):
    """Plans (not rows) are kept per session and scale."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]


def hot_games(spark, sf):
    """Games with too many events for one task; game and period share this list."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("game_id"))
    return _once(spark, sf, "hot", lambda: hot_keys(events, ["game_id"]))


def games(spark, sf) -> DataFrame:
    return _once(spark, sf, "games", lambda: _games(spark, sf))


def _games(spark, sf):
    game = F.col("game_id")
    return (
        table(spark, sf, "events").select(F.col("user_id").alias("game_id")).distinct()
        .join(table(spark, sf, "customer"), F.col("c_custkey") == game)
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "game_id",
            F.col("r_name").alias("competition_id"),
            F.when(game % 2 == 0, "1718").otherwise("1819").alias("season_id"),
            (game % 25).alias("home_team_id"),
            ((game % 25 + 1 + F.floor(game / 25) % 24) % 25).alias("away_team_id"),
            F.date_add(F.lit("2017-08-01").cast("date"), (game * 11 % 280).cast("int")).alias("game_date"),
        )
    )


def _numbered_events(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("game_id"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        # the wall-clock time is meant as UTC, whatever the zone of the session
        F.unix_micros(
            F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
        ).alias("us"),
    )
    return number_rows(events, ["game_id"], ["us", "event_id"], "action_id", hot_games(spark, sf))


def actions(spark, sf) -> DataFrame:
    """Action rows with names and ids."""
    return _once(spark, sf, "actions", lambda: _actions(spark, sf))


def _actions(spark, sf):
    e, k, us = F.col("event_id"), F.col("k"), F.col("us")
    second = us >= HALF

    def tenths(a, b, size):
        return ((e * a + k * b) % size).cast("double") / 10.0

    located = _numbered_events(spark, sf).withColumns(
        {
            "period_id": F.when(second, 2).otherwise(1).cast("long"),
            "start_x": F.lit(60.0) + tenths(7919, 13, 451),
            "start_y": tenths(10473, 7, 681),
            "end_x": tenths(3571, 17, 1051),
            "end_y": tenths(6151, 5, 681),
        }
    )
    dx, dy = F.lit(105.0) - F.col("start_x"), F.lit(34.0) - F.col("start_y")
    named = located.join(games(spark, sf), "game_id").select(
        "game_id", "action_id", "event_id", "period_id",
        ((us - F.when(second, HALF).otherwise(KICKOFF)).cast("double") / 480000000.0).alias("time_seconds"),
        F.when((e * 31 + k) % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        ((e * 13 + k) % 150 + 1).alias("player_id"),
        F.when(F.col("event_type") == "purchase", "shot")
        .when(
            F.col("event_type") == "signup",
            F.when(e % 5 == 0, "shot_freekick").when(e % 5 == 1, "shot_penalty").otherwise("cross"),
        )
        .when(F.col("event_type") == "click", "pass")
        .when(F.col("event_type") == "view", "dribble")
        .otherwise("tackle")
        .alias("type_name"),
        F.when(e % 29 == 0, "owngoal")
        .when(e % 23 == 0, "offside")
        .when(
            ((e * 613 + k * 29) % 100).cast("double")
            < F.greatest(F.lit(4.0), F.lit(70.0) - F.lit(1.5) * F.sqrt(dx * dx + dy * dy)),
            "success",
        )
        .otherwise("fail")
        .alias("result_name"),
        F.when((e + k) % 5 == 0, "head").when((e + k) % 5 == 1, "other").otherwise("foot").alias("bodypart_name"),
        "start_x", "start_y", "end_x", "end_y",
    )
    return named.withColumns(
        {
            "type_id": id_of(F.col("type_name"), TYPES),
            "result_id": id_of(F.col("result_name"), RESULTS),
            "bodypart_id": id_of(F.col("bodypart_name"), BODYPARTS),
        }
    )


def teams(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team_name")
    )


def players(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name")
    )


def data(spark, sf) -> ShotData:
    """The provider with id-keyed actions."""
    ids = actions(spark, sf).drop("type_name", "result_name", "bodypart_name")
    return ShotData(
        games=games(spark, sf), actions=ids, teams=teams(spark, sf),
        players=players(spark, sf), hot=hot_games(spark, sf),
    )


def other_games(spark, sf):
    return games(spark, sf).select(
        (F.col("game_id") + 100000).alias("game_id"), "competition_id", "season_id",
        (F.col("home_team_id") + 1000).alias("home_team_id"),
        (F.col("away_team_id") + 1000).alias("away_team_id"), "game_date",
    )


def other_shots(spark, sf):
    """Shots as a second provider reports them."""
    e = F.col("event_id")
    return (
        actions(spark, sf)
        .filter(F.col("type_name").isin("shot", "shot_penalty", "shot_freekick") & (e % 7 != 0))
        .select(
            (F.col("game_id") + 100000).alias("game_id"), "action_id", "period_id",
            (F.col("team_id") + 1000).alias("team_id"), (F.col("player_id") + 5000).alias("player_id"),
            (F.col("time_seconds") + (e % 9 - 4).cast("double") * 0.875).alias("time_seconds"), "event_id",
        )
    )


def scored(spark, sf):
    """Shots with a deterministic score in place of a model."""
    return (
        actions(spark, sf)
        .filter((F.col("type_name") == "shot") & F.col("result_name").isin("success", "fail"))
        .select(
            "game_id", "action_id", "player_id",
            ((F.col("event_id") * 37 % 401).cast("double") / 401.0).alias("p"),
            F.when(F.col("result_name") == "success", 1).otherwise(0).alias("y"),
        )
    )


# --- the same views as SQL --------------------------------------------------------------

VIEWS = {
    "games": """
  select g.game_id, r_name as competition_id,
         case when g.game_id % 2 = 0 then '1718' else '1819' end as season_id,
         cast(g.game_id % 25 as bigint) as home_team_id,
         cast((g.game_id % 25 + 1 + cast(floor(g.game_id / 25) as bigint) % 24) % 25 as bigint) as away_team_id,
         date '2017-08-01' + cast(g.game_id * 11 % 280 as integer) as game_date
  from (select distinct user_id as game_id from events) g
  join customer on c_custkey = g.game_id
  join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey""",
    "ev": """
  select event_id, user_id as game_id, event_type,
         cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) as us from events""",
    "ev2": """
  select event_id, game_id, event_type, k, us,
         cast(case when us < 1705363200000000 then 1 else 2 end as bigint) as period_id,
         cast(row_number() over (partition by game_id order by us, event_id) - 1 as bigint) as action_id,
         60.0e0 + cast((event_id * 7919 + k * 13) % 451 as double) / 10.0e0 as start_x,
         cast((event_id * 10473 + k * 7) % 681 as double) / 10.0e0 as start_y,
         cast((event_id * 3571 + k * 17) % 1051 as double) / 10.0e0 as end_x,
         cast((event_id * 6151 + k * 5) % 681 as double) / 10.0e0 as end_y
  from ev""",
    "ev3": """
  select ev2.*, sqrt((105 - start_x) * (105 - start_x) + (34 - start_y) * (34 - start_y)) as d0 from ev2""",
    "named": """
  select e.game_id, e.action_id, e.event_id, e.period_id,
         cast(us - case when e.period_id = 1 then 1704067200000000 else 1705363200000000 end as double)
           / 480000000.0e0 as time_seconds,
         case when (event_id * 31 + k) % 2 = 0 then home_team_id else away_team_id end as team_id,
         cast((event_id * 13 + k) % 150 + 1 as bigint) as player_id,
         case event_type
           when 'purchase' then 'shot'
           when 'signup' then case when event_id % 5 = 0 then 'shot_freekick'
                                   when event_id % 5 = 1 then 'shot_penalty' else 'cross' end
           when 'click' then 'pass' when 'view' then 'dribble' else 'tackle' end as type_name,
         case when event_id % 29 = 0 then 'owngoal'
              when event_id % 23 = 0 then 'offside'
              when cast((event_id * 613 + k * 29) % 100 as double) < greatest(4.0e0, 70.0e0 - 1.5e0 * d0) then 'success'
              else 'fail' end as result_name,
         case (event_id + k) % 5 when 0 then 'head' when 1 then 'other' else 'foot' end as bodypart_name,
         start_x, start_y, end_x, end_y
  from ev3 e join games g on e.game_id = g.game_id""",
    "actions": """
  select *,
         list_position(['pass','cross','dribble','tackle','shot','shot_penalty','shot_freekick'], type_name) - 1 as type_id,
         list_position(['fail','success','offside','owngoal'], result_name) - 1 as result_id,
         list_position(['foot','head','other'], bodypart_name) - 1 as bodypart_id
  from named""",
}

EXTRA_VIEWS = {
    "teams": "select cast(n_nationkey as bigint) as team_id, n_name as team_name from nation",
    "players": "select c_custkey as player_id, c_name as player_name from customer",
    "other_games": """
  select game_id + 100000 as game_id, competition_id, season_id, home_team_id + 1000 as home_team_id,
         away_team_id + 1000 as away_team_id, game_date from games""",
    "other_shots": """
  select game_id + 100000 as game_id, action_id, period_id, team_id + 1000 as team_id,
         player_id + 5000 as player_id,
         time_seconds + cast(event_id % 9 - 4 as double) * 0.875e0 as time_seconds, event_id
  from actions
  where type_name in ('shot', 'shot_penalty', 'shot_freekick') and event_id % 7 <> 0""",
    "scored": """
  select game_id, action_id, player_id, cast((event_id * 37) % 401 as double) / 401.0e0 as p,
         case when result_name = 'success' then 1 else 0 end as y
  from actions where type_name = 'shot' and result_name in ('success', 'fail')""",
    # the shot and the two actions before it as structs
    "lagged": """
  select game_id, action_id, type_name, result_name, home_team_id, a0,
         coalesce(lag(a0, 1) over w, first(a0) over w) as a1,
         coalesce(lag(a0, 2) over w, first(a0) over w) as a2
  from (select a.game_id, a.action_id, a.period_id, a.time_seconds, a.type_name, a.result_name, g.home_team_id,
               struct_pack(action_id := a.action_id, period_id := a.period_id, time_seconds := a.time_seconds,
                 team_id := a.team_id, type_name := a.type_name, result_name := a.result_name,
                 bodypart_name := a.bodypart_name, start_x := a.start_x, start_y := a.start_y,
                 end_x := a.end_x, end_y := a.end_y) as a0
        from actions a join games g on a.game_id = g.game_id) t
  window w as (partition by game_id, period_id order by time_seconds, action_id)""",
}


def _flip(i):
    away = "a0.team_id <> home_team_id"
    masked = i == 0
    end = (
        "end_x := cast(null as double), end_y := cast(null as double), result_name := cast(null as varchar)"
        if masked
        else f"end_x := case when {away} then 105 - a{i}.end_x else a{i}.end_x end, "
        f"end_y := case when {away} then 68 - a{i}.end_y else a{i}.end_y end, result_name := a{i}.result_name"
    )
    return (
        f"struct_pack(time_seconds := a{i}.time_seconds, team_id := a{i}.team_id, type_name := a{i}.type_name, "
        f"bodypart_name := a{i}.bodypart_name, "
        f"start_x := case when {away} then 105 - a{i}.start_x else a{i}.start_x end, "
        f"start_y := case when {away} then 68 - a{i}.start_y else a{i}.start_y end, {end}) as a{i}"
    )


# states of the counted shots, playing left to right, without post-shot attributes
EXTRA_VIEWS["states"] = f"""
  select game_id, action_id, result_name, type_name as shot_type, {", ".join(_flip(i) for i in range(3))}
  from lagged
  where type_name in ('shot', 'shot_penalty', 'shot_freekick') and result_name in ('fail', 'success')"""


def sql(body: str, *views: str) -> str:
    """A query text over the base views and the named extra ones (``states`` needs ``lagged``)."""
    chosen = dict(VIEWS)
    for v in views:
        if v == "states":
            chosen["lagged"] = EXTRA_VIEWS["lagged"]
        chosen[v] = EXTRA_VIEWS[v]
    ctes = ",\n".join(f"{name} as ({text})" for name, text in chosen.items())
    lead = body.strip()
    if lead.startswith("with "):
        return f"with {ctes},\n{lead[5:]}"
    return f"with {ctes}\n{lead}"
