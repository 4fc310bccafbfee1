import json
import os
import random
import warnings

import pytest
from pyspark.sql import functions as F

from shotspark.operators import match
from shotspark.scale import materialize, scratch_path
from shotspark.sources import ingest, store, tables


def test_load_table(spark):
    root = scratch_path(spark, "data")
    spark.createDataFrame([(1, "a")], "game_id int, x string").write.parquet(f"{root}/one/games")
    spark.createDataFrame([(2, 3.0)], "game_id int, y double").write.parquet(f"{root}/two/games")
    spark.createDataFrame([(1,)], "team_id int").write.parquet(f"{root}/one/teams")
    paths = {f"{root}/one", f"{root}/two"}  # any iterable
    df = tables.load_table(spark, paths, "games")
    assert set(df.columns) == {"game_id", "x", "y", "db_path"} and df.count() == 2
    assert tables.load_table(spark, paths, "teams").count() == 1
    with pytest.raises(ValueError):
        tables.load_table(spark, paths, "players")
    with pytest.raises(ValueError):
        tables.load_table(spark, [f"{root}/three"], "games")


def test_load_provider(spark, data):
    root = scratch_path(spark, "provider")
    data.actions.write.parquet(f"{root}/actions")
    data.games.union(data.games).write.parquet(f"{root}/games")
    loaded = tables.ShotData.load(spark, root)
    assert loaded.games.count() == data.games.count() and loaded.players is None
    assert loaded.get_actions([1, 2]).count() == data.actions.filter("game_id in (1, 2)").count()
    pairs = [("ASIA", "1718")]
    assert loaded.restrict(loaded.select_games(pairs)).actions.select("game_id").distinct().count() == loaded.select_games(pairs).count()
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        loaded.get_actions(features=True)
    assert caught


def test_dedupe_keeps_the_last(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in tables.dedupe(df, ["k"], ["o"]).collect()) == [(1, "b"), (2, None)]


def test_sides(data):
    home, away, both = [data.get_actions(side=s).count() for s in ("home", "away", None)]
    assert home + away == both
    with pytest.raises(ValueError):
        data.get_actions(side="both")


def test_strict_names(spark):
    table = spark.createDataFrame([(1, "x")], "team_id int, team_name string")
    df = spark.createDataFrame([(1,), (2,)], "team_id int")
    assert sorted(str(r.team_name) for r in tables.with_names(df, table, "team").collect()) == ["None", "x"]
    with pytest.raises(Exception, match="no team with id 2"):
        tables.with_names(df, table, "team", strict=True).collect()


def test_search_ignores_case(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["Kevin", "kEVa", "Bo"])], "id int, n string")
    assert [r.id for r in tables.search_names(df, "n", "KEV", "id", 1).collect()] == [0]


def test_feature_store_reads_only_the_wanted_directories(spark):
    games = spark.createDataFrame([(1, "A", "1718"), (2, "B", "1718")], "game_id int, competition_id string, season_id string")
    df = spark.createDataFrame([(1, 0, 1.5), (2, 0, 2.5)], "game_id int, action_id int, f double")
    path = scratch_path(spark, "store")
    store.write_features(df, games, path)
    part = store.read_features(spark, path, [("B", 1718)])
    assert [r.f for r in part.collect()] == [2.5]
    assert len(part.inputFiles()) == 2 and part._jdf.queryExecution().executedPlan().toString().count("season_id#") > 0
    assert "PartitionFilters: [isnotnull(competition_id" in part._jdf.queryExecution().executedPlan().toString()
    assert store.read_features(spark, path).count() == 2


def test_feature_store_grows_by_season(spark):
    path = scratch_path(spark, "store")
    for game, season in ((1, "0910"), (2, "1011"), (3, "0910")):
        games = spark.createDataFrame([(game, "A", season)], "game_id int, competition_id string, season_id string")
        store.write_features(spark.createDataFrame([(game, 0, 1.5)], "game_id int, action_id int, f double"), games, path)
    got = sorted((r.season_id, r.game_id) for r in store.read_features(spark, path).collect())
    assert got == [("0910", 3), ("1011", 2)]  # a season that is written again is replaced
    assert store.read_features(spark, path, [("A", "0910")]).count() == 1


@pytest.mark.parametrize("rows", [[(1, "a", 5), (1, "b", 5)], [(1, "b", 5), (1, "a", 5)]])
def test_dedupe_does_not_depend_on_order(spark, rows):
    df = spark.createDataFrame(rows, "k int, x string, t int")
    assert tables.dedupe(df, ["k"], ["t"]).collect() == [(1, "b", 5)]


FLAT = "match_id long, home_team_id long"


def test_json_documents_and_broken_input(spark):
    root = scratch_path(spark, "json")
    indented = '[\n  {"match_id": 1,\n   "home_team_id": 7},\n  {"match_id": 2}\n]'
    spark.createDataFrame([(indented,)], "v string").coalesce(1).write.text(f"{root}/whole")
    got = ingest.read_json(spark, f"{root}/whole", FLAT)
    assert sorted((r.match_id, r.home_team_id) for r in got.collect()) == [(1, 7), (2, None)]
    spark.createDataFrame([('{"match_id": 1}',), ('{"match_id": 2}',)], "v string").coalesce(1).write.text(f"{root}/lines")
    assert ingest.read_json(spark, f"{root}/lines", FLAT, lines=True).count() == 2
    spark.createDataFrame([('[{"match_id": 1}, {"match',)], "v string").write.text(f"{root}/broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.read_json(spark, f"{root}/broken", FLAT).collect()


def test_escapes_keep_other_backslashes(spark):
    texts = [r"C:\dir", "end\\", r"\u00e9\n", r"\ud83d\ude00!", r"\u12", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ingest.decode_escapes(F.col("t"))).collect()]
    assert got == [r"C:\dir", "end\\", "é\\n", "\U0001f600!", r"\u12", "", None]


def test_actions_of_given_games_and_further_tables(spark, data):
    ids = [r.game_id for r in data.games.limit(3).collect()]
    assert data.only(ids).games.count() == 3 and data.only(None) is data
    root = scratch_path(spark, "provider")
    data.actions.write.parquet(f"{root}/actions")
    data.games.write.parquet(f"{root}/games")
    pairs = spark.createDataFrame([(1, 2, 3), (1, 2, 3)], "game_id int, team_id int, player_id int")
    pairs.write.parquet(f"{root}/player_games")
    spark.createDataFrame([("u",)], "file_url string").write.parquet(f"{root}/files")
    loaded = tables.ShotData.load(spark, root)
    assert loaded.player_games.count() == 1 and loaded.files.count() == 1


def test_escapes(spark):
    texts = ['Andr\\u00e9 "Z"', "line\nbreak", "\\u0041"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ingest.decode_escapes(F.col("t"))).collect()] == ['André "Z"', "line\nbreak", "A"]


def put(root, name, records):
    """A file as providers publish them."""
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(records, f, indent=2)


def open_data(root, lineups=True):
    put(root, "competitions.json", [
        {"competition_id": 9, "season_id": 3, "competition_name": "Cup", "season_name": "2018"},
        {"competition_id": 9, "season_id": 4, "competition_name": "Cup", "season_name": "2019"},
        {"competition_id": 2, "season_id": 3, "competition_name": "Other", "season_name": "2018"},
    ])

    def match(i, competition, season, home, away):
        return {
            "match_id": i, "match_date": "2018-06-14", "kick_off": "17:00:00.000", "competition": {"competition_id": competition},
            "season": {"season_id": season}, "home_team": {"home_team_id": home, "home_team_name": f"T{home}"},
            "away_team": {"away_team_id": away}, "home_score": 5,
        }

    put(root, "matches/9/3.json", [match(100, 9, 3, 1, 2), match(101, 9, 3, 2, 1)])
    put(root, "matches/9/4.json", [match(102, 9, 4, 3, 1)])
    put(root, "matches/2/3.json", [match(200, 2, 3, 7, 8)])

    def event(team, player):
        found = {"id": "x", "index": 1, "type": {"id": 30, "name": "Pass"}, "team": {"id": team, "name": f"T{team}"}}
        return found | ({"player": {"id": player, "name": f"P{player}"}} if player else {})

    put(root, "events/100.json", [event(1, None), event(1, 11), event(2, 21), event(1, 11)])
    put(root, "events/101.json", [event(2, 21), event(1, 12)])
    put(root, "events/102.json", [event(3, 31)])
    put(root, "events/200.json", [event(7, 71)])
    if lineups:
        for i, sides in ((100, {1: (11, 13), 2: (21,)}), (101, {1: (12,), 2: (21,)}), (102, {3: (31,)}), (200, {7: (71,)})):
            put(root, f"lineups/{i}.json", [
                {"team_id": t, "team_name": f"T{t}", "lineup": [{"player_id": p, "player_name": f"P{p}", "country": {"id": 1}} for p in players]}
                for t, players in sides.items()
            ])


@pytest.mark.parametrize("lineups", [True, False])
def test_open_data_from_nested_files(spark, tmp_path, lineups):
    open_data(str(tmp_path), lineups)
    out = ingest.read_open_data(spark, str(tmp_path), {"Cup": "WC"}, {3: "2018", 4: "2019"})
    games = sorted((r.game_id, r.competition_id, r.season_id, r.home_team_id, r.away_team_id) for r in out["games"].collect())
    assert games == [(100, "WC", "2018", 1, 2), (101, "WC", "2018", 2, 1), (102, "WC", "2019", 3, 1)]
    assert {(r.team_id, r.team_name) for r in out["teams"].collect()} == {(1, "T1"), (2, "T2"), (3, "T3")}
    players = {11, 12, 21, 31} | ({13} if lineups else set())
    assert {(r.player_id, r.player_name) for r in out["players"].collect()} == {(p, f"P{p}") for p in players}
    took_part = sorted((r.game_id, r.team_id, r.player_id) for r in out["player_games"].collect())
    assert took_part == [(100, 1, 11), (100, 2, 21), (101, 1, 12), (101, 2, 21), (102, 3, 31)]


def test_documents_are_written_by_tasks(spark, monkeypatch):
    from workload import files

    rows = spark.range(300).withColumns({"game": F.col("id") % 7, "name": F.concat(F.lit('é"\n'), F.col("id")), "at": 1000 - F.col("id")})
    root, stored = scratch_path(spark, "documents"), scratch_path(spark, "documents")
    file = F.concat(F.lit("events/"), "game")
    files._write_stored(rows.select(file.alias("file"), "at", F.to_json(F.struct("id", "name"), {"pretty": "true"}).alias("value")), stored)
    # no file is renamed or written by the driver, which would take milliseconds for each
    monkeypatch.setattr(files, "_write_stored", lambda *a: pytest.fail("the driver renames each file"))
    files.write_documents(rows, root, file, "at", ["game"])
    folder = root.removeprefix("file:")
    assert sorted(os.listdir(f"{folder}/events")) == [f"{g}.json" for g in range(7)]
    for g in range(7):
        text = open(f"{folder}/events/{g}.json", encoding="utf-8").read()
        assert text == open(f"{stored.removeprefix('file:')}/events/{g}.json", encoding="utf-8").read()
        assert [r["id"] for r in json.loads(text)] == [i for i in range(299, -1, -1) if i % 7 == g]
    read = ingest.read_json(spark, f"{root}/events", "id long, name string")
    assert read.rdd.getNumPartitions() <= 7 and read.count() == 300
    assert read.filter(ingest.number_of_file() == F.col("id") % 7).count() == 300


def test_files_of_another_layout_raise(spark, tmp_path):
    open_data(str(tmp_path))
    flat = [{"match_id": 100, "match_date": "2018-06-14", "competition_id": 9, "season_id": 3, "home_team_id": 1, "away_team_id": 2}]
    for name in ("9/3", "9/4", "2/3"):
        put(str(tmp_path), f"matches/{name}.json", flat)
    with pytest.raises(ValueError, match="matches: no record has competition.competition_id"):
        ingest.read_open_data(spark, str(tmp_path), {"Cup": "WC"}, {3: "2018"})
    dump(str(tmp_path / "dump"))
    put(str(tmp_path / "dump"), "events_Spain.json", [{"game_id": 10, "event_id": 1}])
    put(str(tmp_path / "dump"), "events_Peru.json", [])
    with pytest.raises(ValueError, match="events: no record has id"):
        ingest.read_event_dump(spark, str(tmp_path / "dump"), {"Spain": "ES"}, {7: "1718"})


def dump(root):
    put(root, "competitions.json", [
        {"wyId": 1, "name": "Cup", "area": {"name": "", "id": "0"}}, {"wyId": 2, "name": "Liga", "area": {"name": "Spain", "id": "724"}},
        {"wyId": 3, "name": "Other", "area": {"name": "Peru", "id": "604"}},
    ])

    def match(i, competition, teams):
        return {"wyId": i, "competitionId": competition, "seasonId": 7, "dateutc": "2018-05-20 18:45:00", "label": "A - B, 1 - 0", "teamsData": teams}

    def side(team, name, formation):
        return {"teamId": team, "side": name, "score": 1, "hasFormation": 1, "formation": formation}

    lineup = {
        "lineup": [{"playerId": 1, "goals": "0"}, {"playerId": 4, "goals": "1"}], "bench": [{"playerId": 5}],
        "substitutions": [{"playerIn": 5, "playerOut": 4, "minute": 60}],
    }
    other = {"lineup": [{"playerId": 2}], "bench": [], "substitutions": "null"}
    put(root, "matches_Cup.json", [match(10, 1, {"5": side(5, "home", lineup), "6": side(6, "away", other)})])
    put(root, "matches_Spain.json", [match(12, 2, {"6": side(6, "away", "null"), "9": side(9, "home", "null")})])
    put(root, "matches_Peru.json", [match(11, 3, {"5": side(5, "home", lineup), "8": side(8, "away", other)})])

    def event(i, game, period, second, team, player, subtype, tags=()):
        return {
            "id": i, "eventId": 8, "matchId": game, "matchPeriod": period, "eventSec": second, "teamId": team, "playerId": player,
            "subEventId": subtype, "subEventName": "x", "tags": [{"id": t} for t in tags], "positions": [{"x": 1, "y": 2}],
        }

    put(root, "events_Cup.json", [
        event(100, 10, "1H", 9.0, 5, 1, 82), event(101, 10, "1H", 3.0, 6, 2, 81, [403]), event(102, 10, "2H", 2700.0, 5, 5, 30, [1801, 403]),
        event(103, 10, "2H", 1.0, 6, 0, ""),
    ])
    put(root, "events_Spain.json", [event(300, 12, "1H", 5.0, 9, 7, 30, [1801]), event(301, 12, "1H", 5.0, 6, 2, 30)])
    put(root, "events_Peru.json", [event(200, 11, "1H", 1.0, 5, 3, 1)])
    put(root, "players.json", [{"wyId": i, "shortName": n, "firstName": "f", "lastName": "l"} for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, r"d\u00e9"), (5, "e"), (7, "g"))])
    put(root, "teams.json", [{"wyId": i, "name": n, "officialName": n, "area": {"name": "Spain"}} for i, n in ((5, "x"), (6, "y"), (8, "z"), (9, "v"))])


def test_event_dump_from_json(spark, tmp_path):
    dump(str(tmp_path))
    out = ingest.read_event_dump(spark, str(tmp_path), {"Cup": "CU", "Spain": "ES"}, {7: "1718"})
    games = sorted((r.game_id, r.competition_id, r.season_id, str(r.game_date), r.home_team_id, r.away_team_id) for r in out["games"].collect())
    assert games == [(10, "NULL", "1718", "2018-05-20", 5, 6), (12, "ES", "1718", "2018-05-20", 9, 6)]  # an area is empty
    acts = [(r.game_id, r.event_id, r.action_id, r.bodypart_name, r.player_id) for r in out["actions"].orderBy("game_id", "action_id").collect()]
    assert acts == [
        (10, 101, 0, "other", 2), (10, 100, 1, "head", 1), (10, 103, 2, "foot", None), (10, 102, 3, "head", 5),
        (12, 300, 0, "foot", 7), (12, 301, 1, "foot", 2),
    ]
    played = sorted((r.game_id, r.team_id, r.player_id, r.minutes_played) for r in out["player_games"].collect())
    assert played == [(10, 5, 1, 90.0), (10, 5, 4, 60.0), (10, 5, 5, 30.0), (10, 6, 2, 90.0), (12, 6, 2, None), (12, 9, 7, None)]
    assert {r.player_id: r.player_name for r in out["players"].collect()} == {1: "a", 2: "b", 4: "dé", 5: "e", 7: "g"}
    assert {r.team_id for r in out["teams"].collect()} == {5, 6, 9}


# --- matching ---------------------------------------------------------------------------


def test_ratio_values(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("Manchester United", "Man United"), ("", "a"), (None, "a"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(match.name_ratio(F.col("a"), F.col("b"))).collect()] == [62, 74, 0, 0, 100]


def ratio(a, b):
    """From the table of common subsequences."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return round(200 * table[-1][-1] / (len(a) + len(b))) if a and b else 0


def test_ratios_of_short_and_long_names():
    rng = random.Random(4)
    names = [[None, "a\0b", *("".join(rng.choices("abcé漢 ", k=rng.choice([0, 1, 5, 20, 63, 64, 65, 90]))) for _ in range(150))] for _ in range(2)]
    assert match._similarity()(*names).tolist() == [ratio(x or "", y or "") for x, y in zip(*names)]


def brute_force(left, right, threshold):
    out = {}
    for i, name in left:
        best, found = threshold, (0, "unknown")
        for j, other in sorted(right):
            score = ratio(name, other)
            if score > best:
                best, found = score, (j, other)
        out[i] = found
    return out


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_match_names_against_all_pairs(spark, threshold):
    rng = random.Random(12)
    words = ["Real", "Madrid", "United", "City", "Atletico", "Club", "Sporting", "FC", "Inter", "Roma"]
    right = [(j, " ".join(rng.sample(words, rng.randint(1, 3)))) for j in range(60)]

    def spoil(name):
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(name) + 1)
            name = rng.choice([name[:at] + rng.choice("aeiou ") + name[at:], name[:at] + name[at + 1:]]) or "x"
        return name

    left = [(100 + i, spoil(rng.choice(right)[1])) for i in range(80)] + [(500, ""), (501, "zzzz")]
    lt = spark.createDataFrame(left, "id long, name string")
    rt = spark.createDataFrame(right, "id long, name string")
    got = {r.df1_id: (r.df2_id, r.df2_name) for r in match.match_names(lt, rt, threshold).collect()}
    assert got == brute_force(left, right, threshold)


@pytest.mark.parametrize("drops", [1, 2])
def test_near_names_are_joined_without_the_driver(spark, drops):
    rng = random.Random(drops)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)})
    left, right = words[::2], words[1::3] + ["abc" * 8]
    lt = materialize(spark.createDataFrame([(w,) for w in left], "l string"))
    rt = materialize(spark.createDataFrame([(w, i) for i, w in enumerate(right)], "r string, rid long"))
    near = match._near_matches(lt, rt, drops)
    # exploded names are many more rows than the optimizer takes them for
    joins = [line for line in near._sc._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "simple").splitlines() if "Join [part" in line]
    assert joins and not any("Broadcast" in line for line in joins)

    def common(a, b):
        parts = [{a[:0]}, {b[:0]}]
        for side, text in enumerate((a, b)):
            level = {text}
            parts[side] |= level
            for _ in range(drops):
                level = {w[:i] + w[i + 1 :] for w in level if len(w) > 1 for i in range(len(w))}
                parts[side] |= level
        return max(map(len, parts[0] & parts[1]))

    want = {}
    for a in left:
        found = [(round(200 * n / (len(a) + len(b))), -i) for i, b in enumerate(right) if (n := common(a, b))]
        if found:
            want[a] = max(found)
    assert {r["l"]: (r["score"], -r["rid"]) for r in near.collect()} == want


def test_first_game_wins(spark):
    schema = "game_id long, home_team_id long, away_team_id long, competition_id string, season_id string"
    games = spark.createDataFrame([(1, 5, 6, "A", "1718")], schema)
    other = spark.createDataFrame([(90, 15, 16, "A", "1718"), (80, 15, 16, "A", "1718"), (70, 16, 15, "A", "1718")], schema)
    maps = spark.createDataFrame([(5, 15), (6, 16)], "team_id long, other_team_id long")
    assert [tuple(r) for r in match.match_games(games, other, maps).collect()] == [(1, 80)]
