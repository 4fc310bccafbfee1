"""Table access, ingest, matching between providers, reports."""

from pyspark.sql import functions as F

from shotspark.functions.filters import any_shot, field_of
from shotspark.operators import match, report
from shotspark.scale import scratch_path
from shotspark.sources import ingest, tables
from workload import adapter
from workload.adapter import sql
from workload.catalog import query, rounded
from workload.files import write_documents

KEY = ["game_id", "action_id"]


# --- tables -----------------------------------------------------------------------------


@query(
    "load_union",
    """select event_id, event_type, case when event_id % 2 = 0 then props end as props,
       case when event_id % 2 = 0 then 'even' else 'odd' end as dataset from events""",
)
def _(spark, sf):
    """One table from two datasets, one of which lacks a column."""
    root = scratch_path(spark, "datasets")
    events = adapter.table(spark, sf, "events")
    events.filter("event_id % 2 = 0").write.parquet(f"{root}/even/events")
    events.filter("event_id % 2 = 1").drop("props").write.parquet(f"{root}/odd/events")
    union = tables.load_table(spark, [f"{root}/even", f"{root}/odd"], "events")
    return union.select("event_id", "event_type", "props", F.regexp_extract("db_path", "[^/]+$", 0).alias("dataset"))


@query(
    "dedupe_keys",
    """select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) t
where rn = 1""",
)
def _(spark, sf):
    # several orders of a day tie; the order key is the first of the other columns
    latest = tables.dedupe(adapter.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice")


def _raw_events(spark, sf):
    a = adapter.actions(spark, sf)
    return a.select(
        "game_id", "event_id", "team_id", "period_id",
        F.round(F.col("time_seconds") * 1000).cast("long").alias("period_milliseconds"),
    )


@query(
    "game_events",
    sql("""select a.game_id, period_id, cast(round(time_seconds * 1000) as bigint) as period_milliseconds, event_id
from actions a join games g on a.game_id = g.game_id and a.team_id = g.home_team_id
where g.competition_id = 'ASIA'"""),
)
def _(spark, sf):
    """Events of the home teams in the games of one competition."""
    games = adapter.games(spark, sf)
    d = tables.ShotData(games=games, actions=adapter.actions(spark, sf), events=_raw_events(spark, sf))
    events = d.get_events(games.filter("competition_id = 'ASIA'"), side="home")
    return events.select("game_id", "period_id", "period_milliseconds", "event_id")


@query(
    "game_actions",
    sql("""select a.game_id, action_id, team_id, type_id from actions a
join games g on a.game_id = g.game_id and a.team_id = g.away_team_id"""),
)
def _(spark, sf):
    return adapter.data(spark, sf).get_actions(side="away").select(*KEY, "team_id", "type_id")


@query(
    "actions_with_features",
    sql("""select game_id, action_id, type_id, case when type_name = 'shot' then
  round(sqrt(pow(105 - start_x, 2) + pow(34 - start_y, 2)), 6) end as start_dist_to_goal_a0 from actions"""),
)
def _(spark, sf):
    from shotspark.functions import features as fs

    d = adapter.data(spark, sf)
    shots = d.actions.filter(F.col("type_id") == d.vocab.types.index("shot"))
    d.features = fs.on_table(shots, [fs.startpolar], KEY)
    return rounded(d.get_actions(features=True).select(*KEY, "type_id", "start_dist_to_goal_a0"))


@query(
    "home_away",
    sql("select game_id, home_team_id, away_team_id from games where season_id = '1718'"),
)
def _(spark, sf):
    games = adapter.games(spark, sf)
    return tables.home_away(games, games.filter("season_id = '1718'"))


@query(
    "name_lookup",
    sql(
        """select game_id, action_id, player_name, team_name from actions a
left join players p on a.player_id = p.player_id left join teams t on a.team_id = t.team_id""",
        "players", "teams",
    ),
)
def _(spark, sf):
    named = tables.with_names(adapter.actions(spark, sf), adapter.players(spark, sf), "player")
    named = tables.with_names(named, adapter.teams(spark, sf), "team", strict=True)
    return named.select(*KEY, "player_name", "team_name")


@query(
    "search_names",
    """select c_custkey as id, c_name as name, 'player' as kind from (
  select * from customer where regexp_matches(c_name, '(?i)customer#0+[1-3][05]') order by c_custkey limit 10) t
union all
select id, name, kind from (
  select cast(n_nationkey as bigint) as id, n_name as name, 'team' as kind from nation
  where regexp_matches(n_name, '(?i)[ao]n') order by n_nationkey limit 10) u""",
)
def _(spark, sf):
    """The first ten hits, as the feature asks for."""
    people = adapter.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("player").alias("kind")
    )
    teams = adapter.teams(spark, sf).select(
        F.col("team_id").alias("id"), F.col("team_name").alias("name"), F.lit("team").alias("kind")
    )
    found = tables.search_names(people, "name", "customer#0+[1-3][05]", "id")
    return found.unionByName(tables.search_names(teams, "name", "[ao]n", "id"))


# --- ingest -----------------------------------------------------------------------------

LEAGUES = {"ASIA": "AS", "EUROPE": "EU", "AMERICA": "AM"}


@query(
    "ingest_open_json",
    sql("""with g as (select * from games where competition_id in ('ASIA', 'EUROPE', 'AMERICA')),
a as (select actions.* from actions join g on actions.game_id = g.game_id)
select 'games' as kind, game_id as id, case competition_id when 'ASIA' then 'AS' when 'EUROPE' then 'EU' else 'AM' end
         || '/' || season_id || '/' || strftime(game_date, '%Y-%m-%d') || '/' || home_team_id || '/' || away_team_id as name from g
union all select distinct 'teams', team_id, 'Team ' || team_id from a
union all select distinct 'players', player_id, 'Player "' || player_id || '"' from a
union all select 'player_games', game_id, cast(count(distinct (team_id, player_id)) as varchar) from a group by game_id"""),
)
def _(spark, sf):
    """Files with nested records; events and line-ups know their match by the name of the file."""
    root = scratch_path(spark, "open-data")
    games = adapter.games(spark, sf).withColumn("league", F.abs(F.hash("competition_id")).cast("long"))
    season = F.col("season_id").cast("long")
    offered = games.select(
        F.col("league").alias("competition_id"), season.alias("season_id"), F.col("competition_id").alias("competition_name"),
        F.concat(F.lit("Season "), "season_id").alias("season_name"), (F.col("league") * 10000 + season).alias("order"),
    )
    write_documents(offered.distinct(), root, F.lit("competitions"), "order")
    matches = games.select(
        F.col("game_id").alias("match_id"), F.col("game_date").alias("match_date"),
        F.struct(F.col("league").alias("competition_id"), F.col("competition_id").alias("competition_name")).alias("competition"),
        F.struct(season.alias("season_id")).alias("season"),
        F.struct("home_team_id").alias("home_team"), F.struct("away_team_id").alias("away_team"),
        F.col("game_id").alias("order"),
    )
    write_documents(matches, root, F.concat_ws("/", F.lit("matches"), "competition.competition_id", "season.season_id"), "order")
    actions = adapter.actions(spark, sf)
    player = F.concat(F.lit('Player "'), F.col("player_id"), F.lit('"'))
    events = actions.select(
        F.struct(F.col("team_id").alias("id"), F.concat(F.lit("Team "), "team_id").alias("name")).alias("team"),
        F.struct(F.col("player_id").alias("id"), player.alias("name")).alias("player"),
        F.struct(F.col("type_name").alias("name")).alias("type"), F.col("event_id").alias("order"), "game_id",
    )
    write_documents(events, root, F.concat(F.lit("events/"), "game_id"), "order", ["game_id"])
    sides = actions.groupBy("game_id", "team_id").agg(
        F.collect_set(F.struct("player_id", player.alias("player_name"))).alias("lineup")
    ).select("game_id", "team_id", F.concat(F.lit("Team "), "team_id").alias("team_name"), "lineup", F.col("team_id").alias("order"))
    write_documents(sides, root, F.concat(F.lit("lineups/"), "game_id"), "order", ["game_id"])
    out = ingest.read_open_data(spark, root, LEAGUES, {1718: "1718", 1819: "1819"})
    text = F.concat_ws("/", "competition_id", "season_id", F.col("game_date").cast("string"), "home_team_id", "away_team_id")
    parts = [
        out["games"].select(F.lit("games").alias("kind"), F.col("game_id").alias("id"), text.alias("name")),
        out["teams"].select(F.lit("teams").alias("kind"), F.col("team_id").alias("id"), F.col("team_name").alias("name")),
        out["players"].select(F.lit("players").alias("kind"), F.col("player_id").alias("id"), F.col("player_name").alias("name")),
        out["player_games"].groupBy("game_id").count().select(
            F.lit("player_games").alias("kind"), F.col("game_id").alias("id"), F.col("count").cast("string").alias("name")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# one area name is empty, so the competition's own name counts there; players of the second team come
# on for those of the first ten numbers, and every third match has no formation
DUMP_SQL = """with comp as (
  select cast(r_regionkey as bigint) as provider_id, r_name as own, case when r_regionkey % 4 = 3 then '' else r_name end as area
  from region),
sel as (
  select provider_id, case area when 'ASIA' then 'AS' when 'EUROPE' then 'EU' when 'AMERICA' then 'AM' else 'NULL' end as competition_id
  from comp where case when area = '' then own else area end in ('ASIA', 'EUROPE', 'AMERICA')),
g as (
  select games.game_id, sel.competition_id, season_id, home_team_id, away_team_id from games
  join region on r_name = games.competition_id join sel on provider_id = r_regionkey),
acts as (select a.* from actions a join g on a.game_id = g.game_id),
lasted as (select game_id, max(case period_id when 2 then 45 else 0 end + time_seconds / 60) as lasted from acts group by game_id),
sides as (select game_id, unnest([home_team_id, away_team_id]) as team_id from g where game_id % 3 <> 0),
starts as (select game_id, team_id, n from sides, range(1, 12) r(n)),
played as (
  select game_id, team_id, team_id * 11 + n as player_id, case n when 2 then 60.0e0 else lasted end as minutes_played
  from starts join lasted using (game_id)
  union all select game_id, team_id, team_id + 1000, lasted - 60.0e0 from starts join lasted using (game_id) where n = 2
  union all select distinct game_id, team_id, player_id, cast(null as double) from acts
  where game_id % 3 = 0 and player_id <> 7)"""


def _dump_records(spark, sf):
    """The provider's records from the tables, with the columns of the order in files."""
    region = adapter.table(spark, sf, "region")
    area = F.when(F.col("r_regionkey") % 4 == 3, "").otherwise(F.col("r_name"))
    competitions = region.select(
        F.col("r_regionkey").cast("long").alias("wyId"), F.col("r_name").alias("name"), F.struct(area.alias("name")).alias("area")
    )
    numbers = F.sequence(F.lit(1), F.lit(11))

    def side(team, name):
        lineup = F.transform(numbers, lambda n: F.struct((team * 11 + n).cast("long").alias("playerId")))
        subs = F.array(F.struct((team + 1000).alias("playerIn"), (team * 11 + 2).alias("playerOut"), F.lit(60).alias("minute")))
        formation = F.struct(lineup.alias("lineup"), subs.alias("substitutions"))
        return F.struct(F.lit(name).alias("side"), F.when(F.col("game_id") % 3 != 0, formation).alias("formation"))

    home, away = F.col("home_team_id"), F.col("away_team_id")
    teams = F.map_from_arrays(F.array(home.cast("string"), away.cast("string")), F.array(side(home, "home"), side(away, "away")))
    matches = adapter.games(spark, sf).join(region, F.col("r_name") == F.col("competition_id")).select(
        F.col("game_id").alias("wyId"), F.col("r_regionkey").cast("long").alias("competitionId"),
        F.col("season_id").cast("long").alias("seasonId"), F.date_format("game_date", "yyyy-MM-dd 18:45:00").alias("dateutc"),
        teams.alias("teamsData"),
    )
    e = F.col("event_id")
    tags = F.concat(
        F.array(F.struct((e % 50).alias("id"))), F.when(e % 11 == 0, F.array(F.struct(F.lit(403).cast("long").alias("id")))).otherwise(F.array())
    )
    events = adapter.actions(spark, sf).join(adapter.games(spark, sf).select("game_id", "competition_id"), "game_id").select(
        e.alias("id"), F.col("game_id").alias("matchId"), F.when(F.col("period_id") == 2, "2H").otherwise("1H").alias("matchPeriod"),
        F.col("time_seconds").alias("eventSec"), F.col("team_id").alias("teamId"),
        F.when(F.col("player_id") == 7, 0).otherwise(F.col("player_id")).alias("playerId"),
        F.when(e % 17 == 0, "").otherwise((e % 100).cast("string")).alias("subEventId"), tags.alias("tags"), "competition_id",
    )

    def escaped(name):
        return F.replace(F.col(name), F.lit("C"), F.lit("\\u0043"))

    players = adapter.players(spark, sf).select(F.col("player_id").alias("wyId"), escaped("player_name").alias("shortName"))
    named = adapter.teams(spark, sf).select(F.col("team_id").alias("wyId"), escaped("team_name").alias("name"))
    return {"competitions": competitions, "matches": matches, "events": events, "players": players, "teams": named}


def _dump(spark, sf):
    """The tables from records that are not written as files."""
    raw = {}
    for name, records in _dump_records(spark, sf).items():
        if name == "matches":  # a formation is read as text
            as_text = F.transform_values(
                "teamsData", lambda k, v: F.struct(v["side"].alias("side"), F.coalesce(F.to_json(v["formation"]), F.lit("null")).alias("formation"))
            )
            records = records.withColumn("teamsData", as_text)
        raw[name] = records
    raw["players"] = raw["players"].withColumns({"firstName": F.lit(""), "lastName": F.lit("")})
    return ingest.dump_tables(raw, LEAGUES, {1718: "1718", 1819: "1819"}, adapter.hot_games(spark, sf))


@query(
    "ingest_event_json",
    sql(f"""{DUMP_SQL}
select g.game_id, competition_id, season_id, event_id, nullif(case player_id when 7 then 0 else player_id end, 0) as player_id,
       row_number() over (partition by g.game_id order by period_id, time_seconds, event_id) - 1 as action_id,
       case when event_id % 17 <> 0 and event_id % 100 in (81, 36, 21, 90, 91) then 'other'
            when event_id % 17 <> 0 and event_id % 100 = 82 or event_id % 11 = 0 then 'head' else 'foot' end as bodypart
from actions a join g on a.game_id = g.game_id"""),
)
def _(spark, sf):
    """Nested records taken apart: teams by side from a map, the head tag from a list of tags."""
    out = _dump(spark, sf)
    numbered = out["actions"].select("game_id", "event_id", "player_id", "action_id", F.col("bodypart_name").alias("bodypart"))
    return numbered.join(out["games"].select("game_id", "competition_id", "season_id"), "game_id")


ENTITIES_SQL = """
select 'player' as kind, player_id as id, player_name as name from players where player_id in (select player_id from played)
union all select 'team', team_id, team_name from teams
where team_id in (select home_team_id from g union all select away_team_id from g)
union all select 'minutes of team ' || team_id, game_id, cast(count(*) as varchar) || '/' || coalesce(cast(round(sum(minutes_played), 3) as varchar), '-')
from played group by game_id, team_id"""


def _entities(out):
    kinds = [
        out[f"{kind}s"].select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col(f"{kind}_name").alias("name"))
        for kind in ("player", "team")
    ]
    minutes = out["player_games"].groupBy("game_id", "team_id").agg(F.count("*").alias("n"), F.round(F.sum("minutes_played"), 3).alias("m"))
    return kinds[0].unionByName(kinds[1]).unionByName(
        minutes.select(
            F.concat(F.lit("minutes of team "), "team_id").alias("kind"), F.col("game_id").alias("id"),
            F.concat_ws("/", F.col("n").cast("string"), F.coalesce(F.col("m").cast("string"), F.lit("-"))).alias("name"),
        )
    )


@query("ingest_event_entities", sql(f"{DUMP_SQL}{ENTITIES_SQL}", "players", "teams"))
def _(spark, sf):
    """Players that started, came on or, without a formation, stand in the events; their minutes."""
    return _entities(_dump(spark, sf))


@query(
    "ingest_dump_files",
    sql(
        f"""{DUMP_SQL}{ENTITIES_SQL}
union all select 'game', g.game_id, competition_id || '/' || season_id || '/' || cast(count(*) as varchar) || '/'
  || cast(count(distinct team_id) as varchar) from g join actions a on a.game_id = g.game_id
group by g.game_id, competition_id, season_id""",
        "players", "teams",
    ),
)
def _(spark, sf):
    """The dump as indented files, matches and events per competition; names carry escapes."""
    root = scratch_path(spark, "dump")
    raw = _dump_records(spark, sf)
    for name, key in (("competitions", "wyId"), ("players", "wyId"), ("teams", "wyId")):
        write_documents(raw[name].withColumn("order", F.col(key)), root, F.lit(name), "order")
    regions = adapter.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("competitionId"), F.col("r_name").alias("_name"))
    by_file = raw["matches"].withColumn("order", F.col("wyId")).join(regions, "competitionId")
    write_documents(by_file, root, F.concat(F.lit("matches_"), "_name"), "order", ["_name"])
    write_documents(raw["events"].withColumn("order", F.col("id")), root, F.concat(F.lit("events_"), "competition_id"), "order", ["competition_id"])
    out = ingest.read_event_dump(spark, root, LEAGUES, {1718: "1718", 1819: "1819"})
    counted = out["actions"].groupBy("game_id").agg(F.count("*").alias("n"), F.count_distinct("team_id").alias("teams"))
    games = out["games"].join(counted, "game_id").select(
        F.lit("game").alias("kind"), F.col("game_id").alias("id"),
        F.concat_ws("/", "competition_id", "season_id", F.col("n").cast("string"), F.col("teams").cast("string")).alias("name"),
    )
    return _entities(out).unionByName(games)


@query(
    "bodypart_rule",
    """select event_id, case when event_id % 100 in (81, 36, 21, 90, 91) then 'other'
       when event_id % 100 = 82 or event_id % 11 = 0 then 'head' else 'foot' end as bodypart from events""",
)
def _(spark, sf):
    e = F.col("event_id")
    return adapter.table(spark, sf, "events").select("event_id", ingest.bodypart_expr(e % 100, e % 11 == 0).alias("bodypart"))


@query("escape_decode", r"select p_partkey, p_name || ' C:\dir\u00 \' as decoded from part")
def _(spark, sf):
    """Part names, written as escapes, decoded again; backslashes that escape nothing stay."""
    code = F.transform(
        F.split("p_name", ""), lambda c: F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))
    )
    escaped = adapter.table(spark, sf, "part").select("p_partkey", F.concat(F.array_join(code, ""), F.lit(" C:\\dir\\u00 \\")).alias("escaped"))
    return escaped.select("p_partkey", ingest.decode_escapes(F.col("escaped")).alias("decoded"))


# --- matching ---------------------------------------------------------------------------


def _corrupted(name, key):
    """A copy of a name without one or two characters."""
    at = (key % 9 + 2).cast("int")
    cut = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)))
    return F.when(key % 3 == 0, name).when(key % 3 == 1, cut).otherwise(
        F.concat(F.substring(cut, F.lit(1), F.lit(12)), F.substring(cut, F.lit(14), F.length(name)))
    )


CORRUPTED = """corrupted as (
  select c_custkey, c_name, case c_custkey % 3 when 0 then c_name when 1 then cut
         else substr(cut, 1, 12) || substr(cut, 14) end as other_name
  from (select c_custkey, c_name, substr(c_name, 1, cast(c_custkey % 9 + 2 as bigint))
               || substr(c_name, cast(c_custkey % 9 + 2 as bigint) + 2) as cut from customer) t)"""


def _name_pairs(spark, sf):
    key, name = F.col("c_custkey"), F.col("c_name")
    return adapter.table(spark, sf, "customer").select("c_custkey", "c_name", _corrupted(name, key).alias("other_name"))


@query(
    "name_ratio",
    f"""with {CORRUPTED},
masks as (
  select *, list_transform(string_split(other_name, ''), lambda ch: list_sum(list_transform(range(1, length(c_name) + 1),
           lambda i: case when c_name[i] = ch then cast(1 as hugeint) << cast(i - 1 as integer) else 0 end))) as m,
         (cast(1 as hugeint) << cast(length(c_name) as integer)) - 1 as whole
  from corrupted),
rest as (
  select *, list_reduce(list_prepend(whole, list_transform(m, lambda x: cast(x as hugeint))),
           lambda s, x: ((s + (s & x)) | (s - (s & x))) & whole) as s from masks)
select c_custkey, other_name,
       cast(round_even(200.0e0 * (length(c_name) - bit_count(s)) / (length(c_name) + length(other_name)), 0) as integer) as score
from rest""",
)
def _(spark, sf):
    pairs = _name_pairs(spark, sf)
    return pairs.select("c_custkey", "other_name", match.name_ratio(F.col("c_name"), F.col("other_name")).alias("score"))


@query(
    "name_edit_ratio",
    f"""with {CORRUPTED}
select c_custkey, other_name, cast(round(100.0e0 * (1 - levenshtein(c_name, other_name)
  / cast(greatest(length(c_name), length(other_name)) as double))) as integer) as score from corrupted""",
)
def _(spark, sf):
    pairs = _name_pairs(spark, sf)
    return pairs.select("c_custkey", "other_name", match.edit_ratio(F.col("c_name"), F.col("other_name")).alias("score"))


# every pair of different names, by the bit-parallel recurrence; names have less than 64 characters
@query(
    "match_names",
    f"""with {CORRUPTED},
rn as materialized (
  select r, rid, length(r) as lr, (cast(1 as bigint) << cast(length(r) as integer)) - 1 as whole,
    list_transform(range(0, 128), lambda c: cast(coalesce(list_sum(list_transform(range(1, length(r) + 1),
      lambda i: case when unicode(r[i]) = c then cast(1 as bigint) << cast(i - 1 as integer) else 0 end)), 0) as bigint)) as m
  from (select c_name as r, min(c_custkey) as rid from customer group by c_name)),
ln as materialized (
  select l, length(l) as ll, list_transform(string_split(l, ''), lambda ch: cast(unicode(ch) as bigint)) as codes
  from (select distinct other_name as l from corrupted)),
scored as (
  select l, r, rid, lr, ll, list_reduce(list_prepend(whole, codes),
    lambda s, c: ((s + (s & m[c + 1])) | (s - (s & m[c + 1]))) & whole) as s from ln, rn),
best as (
  select l, arg_max(struct_pack(r := r, rid := rid), struct_pack(score := score, rid := -rid)) as b from (
    select l, r, rid, round_even(200.0e0 * (lr - bit_count(s)) / (ll + lr), 0) as score from scored) where score > 75 group by l)
select c_custkey as df1_id, other_name as df1_name, coalesce(b.rid, 0) as df2_id, coalesce(b.r, 'unknown') as df2_name
from corrupted left join best on l = other_name""",
)
def _(spark, sf):
    """Customers against the corrupted copies of their names."""
    pairs = _name_pairs(spark, sf)
    left = pairs.select(F.col("c_custkey").alias("id"), F.col("other_name").alias("name"))
    right = pairs.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return match.match_names(left, right)


def _provider_maps(spark, sf):
    teams = adapter.teams(spark, sf).select("team_id", (F.col("team_id") + 1000).alias("other_team_id"))
    players = adapter.actions(spark, sf).select("player_id").distinct()
    return teams, players.select("player_id", (F.col("player_id") + 5000).alias("other_player_id"))


MATCHED_GAMES = """mg as (
  select g.game_id, min(o.game_id) as other_game_id from games g
  join other_games o on o.home_team_id = g.home_team_id + 1000 and o.away_team_id = g.away_team_id + 1000
    and o.competition_id = g.competition_id and o.season_id = g.season_id
  group by g.game_id)"""


@query("match_games", sql(f"with {MATCHED_GAMES} select game_id, other_game_id from mg", "other_games"))
def _(spark, sf):
    teams, _players = _provider_maps(spark, sf)
    return match.match_games(adapter.games(spark, sf), adapter.other_games(spark, sf), teams)


def shots_sql(same_player):
    return sql(
        f"""with {MATCHED_GAMES},
near as (
  select a.game_id, a.action_id, o.game_id as other_game_id, o.action_id as other_action_id,
         row_number() over (partition by a.game_id, a.action_id
                            order by abs(a.time_seconds - o.time_seconds), o.action_id) as rn,
         abs(a.time_seconds - o.time_seconds) as gap
  from actions a join mg on mg.game_id = a.game_id
  join other_shots o on o.game_id = mg.other_game_id and o.period_id = a.period_id {same_player}
  where a.type_name in ('shot', 'shot_penalty', 'shot_freekick') and a.result_name in ('fail', 'success'))
select game_id, action_id, other_game_id, other_action_id from near where rn = 1 and gap < 3""",
        "other_games", "other_shots",
    )


def _match_shots(spark, sf, players=False, hot=None):
    teams, players_map = _provider_maps(spark, sf)
    shots = adapter.actions(spark, sf).filter(any_shot(field_of()))
    return match.match_shots(
        shots, adapter.games(spark, sf), adapter.other_shots(spark, sf), adapter.other_games(spark, sf),
        teams, players_map if players else None, hot=hot,
    )


@query("match_shots", shots_sql(""))
def _(spark, sf):
    return _match_shots(spark, sf, hot="count")


@query("match_shots_by_player", shots_sql("and o.player_id = a.player_id + 5000"))
def _(spark, sf):
    return _match_shots(spark, sf, players=True, hot="count")


# --- reports ----------------------------------------------------------------------------


@query(
    "top_players_xg",
    sql(
        """select player_id, player_name, round(xg, 6) as "xG" from (
  select a.player_id, any_value(player_name) as player_name, sum(p) as xg
  from scored a left join players on players.player_id = a.player_id
  group by a.player_id order by round(sum(p), 9) desc, a.player_id limit 10) t""",
        "scored", "players",
    ),
)
def _(spark, sf):
    xg = adapter.scored(spark, sf).select("player_id", F.col("p").alias("xG"))
    return rounded(report.top_players(xg, adapter.players(spark, sf)))


@query("competition_list", sql("select distinct competition_id from games"))
def _(spark, sf):
    return tables.competitions(adapter.games(spark, sf))
