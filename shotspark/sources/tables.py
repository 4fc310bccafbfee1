"""Access to datasets: directories that hold one Parquet table per name."""

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.functions.vocab import Vocabulary
from shotspark.scale import number_all

KEYS = {
    "games": ["game_id"],
    "teams": ["team_id"],
    "players": ["player_id"],
    "player_games": ["game_id", "team_id", "player_id"],
    "files": ["file_url"],
}


def load_table(spark: SparkSession, paths, name: str) -> DataFrame:
    """Union of ``<path>/<name>`` over all dataset paths, with all columns of all of them and
    the dataset in ``db_path``. A path without the table is skipped; a path that does not
    exist and a table that no path has are errors."""
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    parts = []
    for path in paths:
        if not _exists(spark, path):
            raise ValueError(f"dataset {path} does not exist")
        table = f"{path.rstrip('/')}/{name}"
        if _exists(spark, table):
            parts.append(spark.read.parquet(table).withColumn("db_path", F.lit(path)))
    if not parts:
        raise ValueError(f"no dataset has a table {name}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def dedupe(df: DataFrame, keys, order=None) -> DataFrame:
    """One row per key, the one with the highest ``order`` values; ties go to the highest values
    of the other columns (``db_path`` last), so the result does not depend on the order of the
    input. An aggregate: rows of a frequent key are reduced before the shuffle, unlike with
    row_number()."""
    order = list(order or [])
    rest = [c for c in df.columns if c not in order and c not in keys and _comparable(df.schema[c].dataType)]
    rest.sort(key=lambda c: c == "db_path")  # stable
    best = F.max_by(F.struct(*df.columns), F.struct(*(order + rest or keys))).alias("_row")
    return df.groupBy(*keys).agg(best).select("_row.*")


def _comparable(kind: T.DataType) -> bool:
    return not any(x in kind.simpleString() for x in ("map<", "variant", "interval"))


@dataclass
class ShotData:
    """The tables of one provider. All members are lazy DataFrames."""

    games: DataFrame
    actions: DataFrame
    events: DataFrame | None = None
    teams: DataFrame | None = None
    players: DataFrame | None = None
    features: DataFrame | None = None
    player_games: DataFrame | None = None
    files: DataFrame | None = None
    vocab: Vocabulary = field(default_factory=Vocabulary)
    hot: DataFrame | str | None = "count"  # games too large for one task, see scale.hot_keys

    @classmethod
    def load(cls, spark: SparkSession, paths, vocab: Vocabulary = Vocabulary()) -> "ShotData":
        """Read the tables that exist; those with a key in KEYS are deduplicated by it."""
        tables = {}
        for name in ("games", "actions", "events", "teams", "players", "features", "player_games", "files"):
            try:
                df = load_table(spark, paths, name)
            except ValueError:
                if name in ("games", "actions"):
                    raise
                continue
            tables[name] = dedupe(df, KEYS[name]) if name in KEYS else df
        return cls(vocab=vocab, **tables)

    def select_games(self, pairs) -> DataFrame:
        return select_games(self.games, pairs)

    def only(self, game_ids) -> "ShotData":
        """The same provider with the given games alone: a list of ids, a table with game_id, or
        None for all. Actions of other games stay in the table; joins to the games drop them."""
        return self if game_ids is None else replace(self, games=of_games(self.games, self.games, game_ids))

    def restrict(self, games: DataFrame) -> "ShotData":
        """The same provider, reduced to the games of another table."""
        ids = games.select("game_id")
        return ShotData(
            games=self.games.join(ids, "game_id", "left_semi"),
            actions=self.actions.join(ids, "game_id", "left_semi"),
            events=self.events, teams=self.teams, players=self.players,
            features=self.features, player_games=self.player_games, files=self.files, vocab=self.vocab, hot=self.hot,
        )

    def get_events(self, game_ids=None, side=None) -> DataFrame:
        return of_games(self.events, self.games, game_ids, side)

    def get_actions(self, game_ids=None, side=None, features: bool = False) -> DataFrame:
        actions = of_games(self.actions, self.games, game_ids, side)
        if not features:
            return actions
        if self.features is None:
            warnings.warn("there are no precomputed features")
            return actions
        return with_features(actions, self.features)

    def home_away(self, game_ids=None) -> DataFrame:
        return home_away(self.games, game_ids)


def of_games(df: DataFrame, games: DataFrame, game_ids=None, side: str | None = None) -> DataFrame:
    """Rows of the given games (a list of ids, a table with game_id, or None for all), of both
    teams or of the ``home`` or ``away`` team."""
    if side not in (None, "home", "away"):
        raise ValueError("side is 'home', 'away' or None for both")
    if isinstance(game_ids, DataFrame):
        df = df.join(game_ids.select("game_id"), "game_id", "left_semi")
    elif game_ids is not None:
        df = df.filter(F.col("game_id").isin(*game_ids))
    if side is None:
        return df
    sides = games.select("game_id", F.col(f"{side}_team_id").alias("team_id"))
    return df.join(sides, ["game_id", "team_id"], "left_semi")


def with_features(actions: DataFrame, features: DataFrame) -> DataFrame:
    """Attach precomputed features by key."""
    return actions.join(features, ["game_id", "action_id"], "left")


def home_away(games: DataFrame, game_ids=None) -> DataFrame:
    return of_games(games, games, game_ids).select("game_id", "home_team_id", "away_team_id")


def with_names(df: DataFrame, table: DataFrame, entity: str, strict: bool = False) -> DataFrame:
    """Add ``{entity}_name``. With ``strict``, an id that is not in the table fails the query."""
    key, name = f"{entity}_id", f"{entity}_name"
    named = df.join(table.select(key, name, F.lit(True).alias("_known")), key, "left")
    if strict:
        message = F.concat(F.lit(f"no {entity} with id "), F.col(key).cast("string"))
        checked = F.when(F.col("_known"), F.col(name)).otherwise(F.raise_error(message))
        named = named.withColumn(name, checked)
    return named.drop("_known")


def search_names(df: DataFrame, column: str, pattern: str, key: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows, by key, whose name contains the pattern in any case."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}")).orderBy(key).limit(limit)


def select_games(games: DataFrame, pairs) -> DataFrame:
    """Games of the given (competition, season) pairs, compared as strings."""
    wanted = F.lit(False)
    for competition, season in pairs:
        wanted = wanted | (
            (F.col("competition_id").cast("string") == str(competition))
            & (F.col("season_id").cast("string") == str(season))
        )
    return games.filter(wanted)


def sample_temporal(
    games: DataFrame, size_val: float = 0.0, size_test: float = 0.2, mode: str = "contiguous"
) -> DataFrame:
    """Add ``split``: train, val or test by date. ``contiguous`` gives every game a split;
    ``reference`` keeps the historical borders, which leave some games out (NULL)."""
    rows = games.count()
    share_train, share_test = (1 - size_val - size_test) * rows, (1 - size_test) * rows
    pos = F.col("_pos")
    if mode == "contiguous":
        # the small term keeps 0.7 * 10 from ending up below 7
        train, val = _floor(share_train + 1e-9), _floor(share_test + 1e-9)
        split = F.when(pos < train, "train").when(pos < val, "val").otherwise("test")
    elif mode == "reference":
        split = (
            F.when(pos < _floor(share_train), "train")
            .when((pos >= _ceil(share_train)) & (pos < _floor(share_test)), "val")
            .when((pos >= _ceil(share_test) + 1) & (pos < rows - 1), "test")
        )
    else:
        raise ValueError(f"unknown mode {mode}")
    numbered = number_all(games, ["game_date", "game_id"], "_pos")
    return numbered.withColumn("split", split).drop("_pos")


def _floor(value: float) -> int:
    return int(value // 1)


def _ceil(value: float) -> int:
    return int(-((-value) // 1))


def competitions(games: DataFrame) -> DataFrame:
    return games.select("competition_id").distinct()
