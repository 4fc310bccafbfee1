"""Actions and game states."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotspark.functions.filters import field_of
from shotspark.functions.vocab import LENGTH, WIDTH, Vocabulary, name_of
from shotspark.scale import POS, chunked, hot_keys, materialize, split_hot

KINDS = ["type", "result", "bodypart"]

# fields of an action that states carry
FIELDS = [
    "action_id", "period_id", "time_seconds", "team_id", "player_id",
    "type_id", "result_id", "bodypart_id", "start_x", "start_y", "end_x", "end_y",
]


def enhance(actions: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """Add type_name, result_name and bodypart_name."""
    return actions.withColumns(
        {f"{k}_name": name_of(F.col(f"{k}_id"), vocab.levels(k)) for k in KINDS}
    )


def with_home(actions: DataFrame, games: DataFrame) -> DataFrame:
    """Add home_team_id. The games table grows with the data, so there is no broadcast hint:
    the optimizer broadcasts it when its size allows, and otherwise the join on game_id leaves
    the partitioning that the state window needs."""
    return actions.join(games.select("game_id", "home_team_id"), "game_id")


def mirror(value, size: float, flip):
    return F.when(flip, F.lit(size) - value).otherwise(value)


def play_left_to_right(actions: DataFrame, games: DataFrame) -> DataFrame:
    """Mirror the actions of the away team, so that both teams attack to the right."""
    away = F.col("team_id") != F.col("home_team_id")
    sizes = {"start_x": LENGTH, "end_x": LENGTH, "start_y": WIDTH, "end_y": WIDTH}
    return (
        with_home(actions, games)
        .withColumns({c: mirror(F.col(c), size, away) for c, size in sizes.items()})
        .select(*actions.columns)
    )


def gamestates(actions: DataFrame, n: int = 3, hot: DataFrame | str | None = "count") -> DataFrame:
    """Add the structs a0 (the action itself) .. a{n-1} (the n-1 actions before it in the
    period; the first action of the period where there are fewer).

    ``hot`` lists the games too large for one task (see ``scale.hot_keys``); by default they
    are counted here, ``None`` says that there are none.
    """
    # the window sees the finished struct, so that rows are sorted with one copy of the fields
    actions = actions.withColumn("a0", F.struct(*[c for c in FIELDS if c in actions.columns]))
    if n == 1:
        return actions
    keys = ["game_id", "period_id"]
    order = ["time_seconds", "action_id"]

    def states(part, group, order):
        w = Window.partitionBy(*group).orderBy(*order)
        start = F.first("a0").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return part.withColumns({f"a{i}": F.coalesce(F.lag("a0", i).over(w), start) for i in range(1, n)})

    if isinstance(hot, str):
        hot = hot_keys(actions, ["game_id"])
    if hot is None:
        return states(actions, keys, order)
    cold, wide = split_hot(actions, hot)
    pieces = states(chunked(wide, keys, order, halo=n - 1), [*keys, "_chunk"], [POS])
    return states(cold, keys, order).unionByName(pieces.filter("_home").drop(POS, "_chunk", "_home"))


def state_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "a" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def flip_states(states: DataFrame) -> DataFrame:
    """Mirror all states of a shot by the away team. Needs the home_team_id column."""
    away = F.col("a0.team_id") != F.col("home_team_id")

    def flipped(name):
        a = field_of(name)
        return (
            F.col(name)
            .withField("start_x", mirror(a("start_x"), LENGTH, away))
            .withField("start_y", mirror(a("start_y"), WIDTH, away))
            .withField("end_x", mirror(a("end_x"), LENGTH, away))
            .withField("end_y", mirror(a("end_y"), WIDTH, away))
        )

    return states.withColumns({c: flipped(c) for c in state_columns(states)})


def mask_postshot(states: DataFrame) -> DataFrame:
    """Remove from the shot what is known only after it: end point and result."""
    nothing = {c: F.lit(None).cast("double") for c in ("end_x", "end_y")}
    masked = F.col("a0")
    for name, value in {**nothing, "result_id": F.lit(None).cast("long")}.items():
        masked = masked.withField(name, value)
    return states.withColumn("a0", masked)


def decode_categories(df: DataFrame, vocab: Vocabulary = Vocabulary(), skip=()) -> DataFrame:
    """Replace ids by names in all columns that start with type_id, result_id, bodypart_id,
    except ``skip``. Columns that already hold names keep the names of the vocabulary."""
    types = dict(df.dtypes)

    def decoded(column, kind):
        levels = vocab.levels(kind)
        if types[column] == "string":
            return F.when(F.col(column).isin(*levels), F.col(column))
        return name_of(F.col(column), levels)

    changed = {c: decoded(c, k) for c in df.columns for k in KINDS if c.startswith(f"{k}_id") and c not in skip}
    return df.withColumns(changed) if changed else df


def varying_columns(df: DataFrame, keys=()) -> list[str]:
    """Columns with more than one distinct non-null value, found in one pass: a column varies
    exactly when its minimum and maximum differ."""
    names = [c for c in df.columns if c not in keys]
    row = df.agg(*[(F.min(f"`{c}`") != F.max(f"`{c}`")).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def drop_constant(df: DataFrame, keys=("game_id", "action_id")) -> DataFrame:
    """Keep the keys and the columns that vary. Fit-time only: store the column list with the
    model and select it when scoring. The table is written first, as it is read twice."""
    df = materialize(df, "features")
    return df.select(*[c for c in keys if c in df.columns], *varying_columns(df, keys))
