"""Provider files to tables. Both readers take files as they come from the providers; the
conversion of single raw events to actions is the provider's business and not done here."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.scale import hot_keys, materialize, number_rows
from shotspark.sources.tables import dedupe

# Event subtypes taken with another body part, and the header subtype
OTHER_SUBTYPES = [81, 36, 21, 90, 91]
HEAD_SUBTYPE = 82

TASK_BYTES = 32_000_000  # of files that a task reads


def decode_escapes(text: Column) -> Column:
    r"""Decode ``\uXXXX`` escapes and keep everything else, other backslashes too. Neighbouring
    escapes are decoded together, so pairs of surrogates come out as one character."""
    escape = r"(?:\\u[0-9a-fA-F]{4})"
    parts = F.regexp_extract_all(text, F.lit(rf"{escape}++|[^\\]++|\\"), F.lit(0))

    def decoded(part):
        quoted = F.concat(F.lit('{"v":"'), part, F.lit('"}'))
        return F.when(part.rlike(rf"\A{escape}"), F.coalesce(F.get_json_object(quoted, "$.v"), part)).otherwise(part)

    return F.array_join(F.transform(parts, decoded), "")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of JSON files below ``path`` (a file, a folder with any folders below, or a pattern),
    and ``_file``, where a record comes from. Providers publish whole documents, mostly indented
    arrays; with ``lines`` each line is a record. Broken input raises, it never becomes empty rows."""
    found = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    # Spark opens few small files in a task; a task that reads many of them is as good, and there are fewer
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    return found.select("*", F.col("_metadata.file_path").alias("_file")).coalesce(tasks)


def require(df: DataFrame, name: str, fields: list[str], by: str = "_file") -> DataFrame:
    """``df`` itself; raises if it has no rows, or if a field is missing in all rows of a file (of
    one value of ``by``). A reader with a schema gives NULL for absent fields, and joins would then
    drop every row."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f"_{i}") for i, f in enumerate(fields)])
    absent = F.filter(F.array(*[F.when(F.col(f"_{i}") == 0, F.lit(f)) for i, f in enumerate(fields)]), lambda f: f.isNotNull())
    row = counts.agg(F.sum("_n"), F.max(F.struct(F.size(absent), absent, F.col(by).cast("string")))).first()
    if not row[0]:
        raise ValueError(f"{name}: no records")
    missing, names, where = row[1]
    if missing:
        raise ValueError(f"{name}: no record has {', '.join(names)} in {where}; this is not the provider's file")
    return df


def has_files(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def number_of_file(column: str = "_file") -> Column:
    """The number that a file ``<number>.json`` is named by."""
    number = F.regexp_extract(column, r"/([0-9]+)\.json(?:\.\w+)?(?:/[^/]*)?$", 1)
    return F.nullif(number, F.lit("")).cast("long")


def bodypart_expr(subtype: Column, head_tag: Column) -> Column:
    """Body part of an event from its subtype and its head/body tag."""
    return (
        F.when(subtype.isin(*OTHER_SUBTYPES), "other")
        .when((subtype == HEAD_SUBTYPE) | F.coalesce(head_tag, F.lit(False)), "head")
        .otherwise("foot")
    )


def mapped(column: Column, mapping: dict) -> Column:
    """Value of a small hand-written mapping, NULL when absent."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), column)


# --- provider with competitions, matches and events per match ---------------------------

COMPETITION_SCHEMA = "competition_id long, season_id long, competition_name string"
MATCH_SCHEMA = (
    "match_id long, match_date date, competition struct<competition_id: long>, season struct<season_id: long>, "
    "home_team struct<home_team_id: long>, away_team struct<away_team_id: long>"
)
EVENT_SCHEMA = "team struct<id: long, name: string>, player struct<id: long, name: string>"
LINEUP_SCHEMA = "team_id long, team_name string, lineup array<struct<player_id: long, player_name: string>>"


def read_open_data(
    spark: SparkSession, path: str, leagues: dict, seasons: dict, lines: bool = False
) -> dict[str, DataFrame]:
    """Tables games, teams, players, player_games from JSON files:

    - ``competitions.json``: a record per competition and season
    - ``matches/<competition>/<season>.json``: matches with nested competition, season and teams
    - ``events/<match>.json``: events, which have their match in the name of the file only
    - ``lineups/<match>.json``: teams with their players; where there are none, the events name them

    ``leagues`` and ``seasons`` map the provider's competition names and season ids to the ids used
    here; competitions without an entry are left out. Files of another layout raise."""

    def read(name, schema):
        return read_json(spark, f"{path}/{name}", schema, lines)

    offered = require(read("competitions*", COMPETITION_SCHEMA), "competitions", ["competition_id", "season_id", "competition_name"])
    competitions = offered.filter(F.col("competition_name").isin(*leagues)).select(
        "competition_id", "season_id",
        mapped(F.col("competition_name"), leagues).alias("_competition"),
        mapped(F.col("season_id"), seasons).alias("_season"),
    ).distinct()
    matches = require(
        read("matches", MATCH_SCHEMA), "matches",
        ["match_id", "match_date", "competition.competition_id", "season.season_id", "home_team.home_team_id", "away_team.away_team_id"],
    )
    games = materialize(
        matches.select("*", "competition.competition_id", "season.season_id")
        .join(competitions, ["competition_id", "season_id"])
        .select(
            F.col("match_id").alias("game_id"), F.col("match_date").alias("game_date"),
            F.col("_competition").alias("competition_id"), F.col("_season").alias("season_id"),
            "home_team.home_team_id", "away_team.away_team_id",
        ),
        "games",
    )
    # a match has few players, so this is small beside the events, which are read once
    seen = require(
        materialize(
            read("events", EVENT_SCHEMA).select(
                number_of_file().alias("game_id"), F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"),
                F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"),
            ).distinct(),
            "seen",
        ),
        "events", ["game_id", "team_id", "player_id"], by="game_id",
    ).join(games.select("game_id"), "game_id", "left_semi")
    named = seen
    if has_files(spark, f"{path}/lineups"):
        sides = require(materialize(read("lineups", LINEUP_SCHEMA), "sides"), "lineups", ["team_id", "lineup"]).select(
            number_of_file().alias("game_id"), "team_id", "team_name", F.explode_outer("lineup").alias("p")
        )
        named = materialize(
            sides.join(games.select("game_id"), "game_id", "left_semi")
            .select("team_id", "team_name", "p.player_id", "p.player_name").distinct(),
            "lineups",
        )
    return {
        "games": games,
        "teams": dedupe(named.filter("team_id is not null").select("team_id", "team_name"), ["team_id"], ["team_name"]),
        "players": dedupe(
            named.filter("player_id is not null").select("player_id", "player_name"), ["player_id"], ["player_name"]
        ),
        "player_games": seen.filter("player_id is not null").select("game_id", "team_id", "player_id").distinct(),
    }


# --- provider with one dump per competition ---------------------------------------------


def name_competitions(competitions: DataFrame, leagues: dict) -> DataFrame:
    """Name of a competition: its area, or its own name where the area is empty. The internal
    id comes from the area, 'NULL' when the area is not known."""
    area = F.col("area.name")
    return competitions.select(
        F.col("wyId").alias("provider_id"),
        F.coalesce(F.nullif(area, F.lit("")), F.col("name")).alias("name"),
        F.coalesce(mapped(area, leagues), F.lit("NULL")).alias("competition_id"),
    )


def number_actions(events: DataFrame, order, hot: DataFrame | str | None = "count") -> DataFrame:
    """Add action_id 0..n-1 in each game, in the given order. ``hot`` as for game states."""
    if isinstance(hot, str):
        hot = hot_keys(events, ["game_id"])
    return number_rows(events, ["game_id"], order, "action_id", hot)


# Fixed values of the provider's records: tag of headers, periods with the minute they start at
HEAD_TAG = 403
PERIODS = {"1H": (1, 0), "2H": (2, 45), "E1": (3, 90), "E2": (4, 105), "P": (5, 120)}

#: Records as published. A formation is an object or the text "null", and so are its substitutions.
DUMP_SCHEMAS = {
    "competitions": "wyId long, name string, area struct<name: string>",
    "matches": "wyId long, competitionId long, seasonId long, dateutc string, "
    "teamsData map<string, struct<side: string, formation: string>>",
    "events": "id long, matchId long, matchPeriod string, eventSec double, teamId long, playerId long, "
    "subEventId string, tags array<struct<id: long>>",
    "players": "wyId long, firstName string, lastName string, shortName string",
    "teams": "wyId long, name string",
}
#: Fields without which a file of that name is not the provider's.
DUMP_FIELDS = {
    "competitions": ["wyId", "name", "area"],
    "matches": ["wyId", "competitionId", "seasonId", "dateutc", "teamsData"],
    "events": ["id", "matchId", "matchPeriod", "eventSec", "teamId", "playerId", "subEventId", "tags"],
    "players": ["wyId", "shortName"],
    "teams": ["wyId", "name"],
}
FORMATION = "lineup array<struct<playerId: long>>, substitutions string"
SUBSTITUTIONS = "array<struct<playerIn: long, playerOut: long, minute: double>>"


def dump_matches(raw: DataFrame) -> DataFrame:
    """game_id, provider_id, season, game_date, home_team_id, away_team_id from match records, whose
    teams are a map from team id to side and formation."""
    sides = F.map_entries("teamsData")

    def team(side):
        return F.get(F.filter(sides, lambda e: e["value"]["side"] == side), F.lit(0))["key"].cast("long")

    return raw.select(
        F.col("wyId").alias("game_id"), F.col("competitionId").alias("provider_id"), F.col("seasonId").alias("season"),
        F.to_date(F.substring("dateutc", 1, 10)).alias("game_date"),
        team("home").alias("home_team_id"), team("away").alias("away_team_id"),
    )


def dump_events(raw: DataFrame) -> DataFrame:
    """game_id, event_id, period_id, time_seconds, minute, team_id, player_id, subtype_id, head_tag from
    event records; the head tag is one of the tags, and player 0 is no player."""
    numbers, starts = ({k: v[i] for k, v in PERIODS.items()} for i in (0, 1))
    return raw.select(
        F.col("matchId").alias("game_id"), F.col("id").alias("event_id"),
        mapped(F.col("matchPeriod"), numbers).cast("long").alias("period_id"), F.col("eventSec").alias("time_seconds"),
        (mapped(F.col("matchPeriod"), starts) + F.col("eventSec") / 60).alias("minute"),
        F.col("teamId").alias("team_id"), F.nullif("playerId", F.lit(0).cast("long")).alias("player_id"),
        F.expr("try_cast(subEventId as bigint)").alias("subtype_id"),
        F.coalesce(F.exists("tags", lambda t: t["id"] == HEAD_TAG), F.lit(False)).alias("head_tag"),
    )


def dump_lineups(raw: DataFrame, events: DataFrame) -> DataFrame:
    """game_id, team_id, player_id, minutes_played of the players that started or came on. A match
    lasts until its last event; teams without a formation have their players from the events, with
    unknown minutes."""
    lasted = events.groupBy("game_id").agg(F.max("minute").alias("lasted"))
    teams = raw.select(F.col("wyId").alias("game_id"), F.explode("teamsData").alias("key", "team")).select(
        "game_id", F.col("key").cast("long").alias("team_id"), F.from_json("team.formation", FORMATION).alias("f")
    )
    subs = F.coalesce(F.from_json("f.substitutions", SUBSTITUTIONS), F.array().cast(SUBSTITUTIONS))
    stays = F.concat(
        F.transform(F.coalesce("f.lineup", F.array().cast("array<struct<playerId: long>>")),
                    lambda p: F.struct(p["playerId"].alias("player_id"), F.lit(0.0).alias("since"))),
        F.transform("subs", lambda s: F.struct(s["playerIn"].alias("player_id"), s["minute"].alias("since"))),
    )
    went = F.filter("subs", lambda s: s["playerOut"] == F.col("p.player_id"))
    left = F.array_min(F.transform(went, lambda s: s["minute"]))
    played = (
        teams.select("game_id", "team_id", subs.alias("subs"), "f")
        .select("game_id", "team_id", "subs", F.explode(stays).alias("p"))
        .filter("p.player_id is not null")
        .join(lasted, "game_id", "left")
        .select("game_id", "team_id", "p.player_id", (F.coalesce(left, "lasted") - F.col("p.since")).alias("minutes_played"))
    )
    seen = events.filter("player_id is not null").select("game_id", "team_id", "player_id").distinct()
    return played.unionByName(
        seen.join(played.select("game_id", "team_id").distinct(), ["game_id", "team_id"], "left_anti"), allowMissingColumns=True
    )


def dump_names(raw: DataFrame, key: str, name: str, *names: str) -> DataFrame:
    """Key and name of player or team records; names hold escapes that were escaped again."""
    return raw.select(F.col("wyId").alias(key), decode_escapes(F.coalesce(*names)).alias(name))


def assemble_dump(
    competitions: DataFrame, matches: DataFrame, events: DataFrame, players: DataFrame, teams: DataFrame,
    leagues: dict, seasons: dict, hot: DataFrame | str | None = "count", player_games: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Relational part of the second provider: name and select competitions, map ids, number the
    actions, and keep players that took part and teams that play.

    competitions(wyId, name, area.name), matches as of ``dump_matches``, events(game_id, event_id,
    period_id, time_seconds, team_id, player_id, subtype_id, head_tag); ``player_games`` as of
    ``dump_lineups``, without it whoever stands in the events took part.
    """
    named = name_competitions(competitions, leagues)
    selected = named.filter(F.col("name").isin(*leagues)).select("provider_id", "competition_id")
    games = matches.join(selected, "provider_id").select(
        "game_id", "competition_id", mapped(F.col("season"), seasons).alias("season_id"),
        "game_date", "home_team_id", "away_team_id",
    )
    kept = events.join(games.select("game_id"), "game_id", "left_semi")
    actions = number_actions(
        kept.withColumn("bodypart_name", bodypart_expr(F.col("subtype_id"), F.col("head_tag"))),
        ["period_id", "time_seconds", "event_id"],
        hot,
    )
    if player_games is None:
        player_games = kept.filter("player_id is not null").select("game_id", "team_id", "player_id").distinct()
    else:
        player_games = player_games.join(games.select("game_id"), "game_id", "left_semi")
    playing = games.select(F.col("home_team_id").alias("team_id")).union(games.select("away_team_id"))
    return {
        "games": games,
        "actions": actions,
        "player_games": player_games,
        "players": players.join(player_games.select("player_id"), "player_id", "left_semi"),
        "teams": teams.join(playing, "team_id", "left_semi"),
    }


def dump_tables(raw: dict[str, DataFrame], leagues: dict, seasons: dict, hot: DataFrame | str | None = "count") -> dict[str, DataFrame]:
    """Tables from the provider's records, by the names of DUMP_SCHEMAS."""
    events = dump_events(raw["events"])
    return assemble_dump(
        raw["competitions"], dump_matches(raw["matches"]), events,
        dump_names(raw["players"], "player_id", "player_name", "shortName", "lastName", "firstName"),
        dump_names(raw["teams"], "team_id", "team_name", "name"),
        leagues, seasons, hot, dump_lineups(raw["matches"], events),
    )


def read_event_dump(
    spark: SparkSession, path: str, leagues: dict, seasons: dict, lines: bool = False
) -> dict[str, DataFrame]:
    """The same from JSON files: ``competitions.json``, ``players.json``, ``teams.json``, and for each
    competition ``matches_<name>.json`` and ``events_<name>.json``. Files of another layout raise.
    Records are parsed once and kept as a table."""
    raw = {
        name: require(materialize(read_json(spark, f"{path}/{name}*", schema, lines), name), name, DUMP_FIELDS[name])
        for name, schema in DUMP_SCHEMAS.items()
    }
    return dump_tables(raw, leagues, seasons)
