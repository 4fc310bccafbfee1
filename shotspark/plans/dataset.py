"""Feature and label tables as one lazy plan over all games."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.functions import features as fs
from shotspark.functions.filters import any_shot, field_of
from shotspark.functions.vocab import LENGTH, WIDTH
from shotspark.operators.actions import (
    decode_categories,
    drop_constant,
    enhance,
    flip_states,
    gamestates,
    mask_postshot,
    state_columns,
    with_home,
)
from shotspark.sources.tables import ShotData

KEY = ["game_id", "action_id"]


def _named_actions(data: ShotData) -> DataFrame:
    return enhance(data.actions, data.vocab)


def _flagged(rows: DataFrame, data: ShotData, flags) -> DataFrame:
    return rows.withColumns({name: f(field_of(vocab=data.vocab)) for name, f in (flags or {}).items()})


def shot_states(data: ShotData, shot_filter=None, n: int = 3, flags=None) -> DataFrame:
    """Game states of the shots, playing left to right, without post-shot attributes."""
    states = gamestates(with_home(_named_actions(data), data.games), n, data.hot)
    shots = states.filter((shot_filter or any_shot)(field_of(vocab=data.vocab)))
    return mask_postshot(flip_states(_flagged(shots, data, flags)))


def shot_features(
    data: ShotData, generators=None, shot_filter=None, n: int = 3, keep=(), only_varying: bool = False, game_ids=None,
    flags=None,
) -> DataFrame:
    """Feature rows keyed by (game_id, action_id), of all or the given games (a list of ids or a
    table). ``keep`` names further columns of the action table to carry along; ``only_varying``
    drops columns with a single value; ``flags`` maps names to further shot filters, which become boolean columns."""
    data = data.only(game_ids)
    keep = [*keep, *(flags or {})]
    generators = fs.all_features if generators is None else generators
    if not generators:
        shots = _named_actions(data).join(data.games.select("game_id"), "game_id", "left_semi")
        shots = _flagged(shots, data, flags)
        return shots.filter((shot_filter or any_shot)(field_of(vocab=data.vocab))).select(*KEY, *keep)
    states = shot_states(data, shot_filter, n, flags)
    # several generators use distance and angle, so they become columns of their own
    names = state_columns(states)
    polar = {c: fs.start_polar_of(field_of(c)) for c in names}
    states = states.withColumns({f"_{k}_{c}": v for c in names for k, v in zip(("distance", "angle"), polar[c])})
    accessors = [field_of(c, (F.col(f"_distance_{c}"), F.col(f"_angle_{c}"))) for c in names]
    columns = [c for g in generators for c in g(accessors)]
    table = decode_categories(states.select(*KEY, *keep, *columns), data.vocab, skip=keep)
    return drop_constant(table, (*KEY, *keep)) if only_varying else table


def shot_labels(data: ShotData, shot_filter=None, game_ids=None) -> DataFrame:
    """(game_id, action_id, goal)."""
    data = data.only(game_ids)
    shots = _named_actions(data).join(data.games.select("game_id"), "game_id", "left_semi")
    goal = (F.col("result_name") == "success").alias("goal")
    return shots.filter((shot_filter or any_shot)(field_of(vocab=data.vocab))).select(*KEY, goal)


def training_frame(data: ShotData, generators=None, shot_filter=None, n: int = 3, game_ids=None) -> DataFrame:
    """Features with the label ``goal``, from the same scan instead of a join."""
    data = data.only(game_ids)
    goal_data = ShotData(
        games=data.games, vocab=data.vocab, hot=data.hot,
        actions=data.actions.withColumn(
            "goal", F.col("result_id") == data.vocab.results.index("success")
        ),
    )
    return shot_features(goal_data, generators, shot_filter, n, keep=["goal"])


def pitch_grid(bodyparts: DataFrame) -> DataFrame:
    """Whole-metre start points over the pitch for every row (bodypart_id) of a small table,
    with the features of the custom models."""
    cells = (
        bodyparts.withColumn("start_x", F.explode(F.sequence(F.lit(0), F.lit(int(LENGTH)))))
        .withColumn("start_y", F.explode(F.sequence(F.lit(0), F.lit(int(WIDTH)))))
        .withColumns({c: F.col(c).cast("double") for c in ("start_x", "start_y")})
    )
    return fs.on_table(cells, [fs.startlocation, fs.startpolar, fs.bodypart, fs.goalangle])
