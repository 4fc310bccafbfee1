"""Matching names, games and shots of two providers."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.scale import POS, chunked, hot_keys, materialize, split_hot

# --- names ------------------------------------------------------------------------------


def _large(names: DataFrame) -> DataFrame:
    """A side of a join that grows with the names. Files of names are far smaller than their rows, and
    the optimizer takes exploded rows for as large as their source; so it would send them to the driver."""
    return names.hint("merge")


def _similarity():
    """The scoring function over two lists of names, self-contained so that tasks need nothing but
    the function."""
    import numpy as np

    def common_lengths(a, b):
        """Lengths of the longest common subsequences of names of at most 64 characters, by the
        bit-parallel recurrence: all pairs take one step per character position."""
        x, y = (np.array(v).view(np.uint32).reshape(len(v), -1) for v in (a, b))
        sizes = [np.fromiter(map(len, v), np.uint64, len(v)) for v in (a, b)]
        full = np.uint64(2**64 - 1) >> (np.uint64(64) - sizes[0])
        places = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        inside = np.arange(x.shape[1]) < sizes[0][:, None]
        row = full.copy()
        for j in range(y.shape[1]):
            same = (x == y[:, j : j + 1]) & inside
            hit = row & np.where(same, places, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            row = np.where(j < sizes[1], ((row + hit) | (row - hit)) & full, row)
        return sizes[0].astype(np.int64) - np.bitwise_count(row).astype(np.int64)

    def common_length(a, b):
        """The same for one pair of any length."""
        seen = {}
        for i, ch in enumerate(a):
            seen[ch] = seen.get(ch, 0) | (1 << i)
        row = full = (1 << len(a)) - 1
        for ch in b:
            hit = row & seen.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    def ratios(a, b):
        a, b = [v or "" for v in a], [v or "" for v in b]
        lengths = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
        out = np.zeros(len(a), np.int32)
        some = lengths.min(axis=1) > 0
        # a zero character would end a name in the matrix of characters
        plain = np.array(["\0" not in x and "\0" not in y for x, y in zip(a, b)], bool)
        short = some & (lengths.max(axis=1) <= 64) & plain
        for at in np.array_split(np.flatnonzero(short), max(1, short.sum() // 4096)):
            if len(at):
                common = common_lengths([a[i] for i in at], [b[i] for i in at])
                out[at] = np.rint(200 * common / lengths[at].sum(axis=1))
        for i in np.flatnonzero(some & ~short):
            out[i] = round(200 * common_length(a[i], b[i]) / int(lengths[i].sum()))
        return out

    return ratios


def name_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two names: share of characters in a longest common subsequence."""
    ratios = _similarity()

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a, b), dtype="int32")

    return F.pandas_udf(batch, T.IntegerType())(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """Variant that stays in the JVM: 100 * (1 - edit distance / longer length), rounded."""
    longest = F.greatest(F.length(a), F.length(b))
    score = F.round(100.0 * (1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))).cast("int")
    return F.coalesce(score, F.lit(0))


def _overlap_needed(length: Column, other: Column, bar: float) -> Column:
    """Characters that two names of these lengths share at least, to score ``bar``."""
    return F.ceil(F.lit(bar / 200.0) * (length + other) - 1e-9)


def _tokens(names: DataFrame, name: str) -> DataFrame:
    """(name, length, token): each character with its number of occurrence in the name, so that
    the tokens two names share are the characters they share."""
    chars = F.split(F.col(name), "")
    exploded = names.select(name, F.length(name).alias("length"), F.posexplode(chars).alias("at", "ch"))
    nth = Window.partitionBy(name, "ch").orderBy("at")  # one name: its characters
    return exploded.withColumn("token", F.concat("ch", F.row_number().over(nth).cast("string"))).drop("at", "ch")


def _candidates(left: DataFrame, right: DataFrame, bar: float) -> DataFrame:
    """All pairs (l, r) of distinct names that can score ``bar`` or more, and few others.

    Lossless: two such names share at least k characters, so when the tokens of both are put
    in one common order (rare first), the first (length - k + 1) tokens of each have one in
    common. Joining on the token and both lengths also applies the bound on the lengths.
    """
    lt, rt = _tokens(left, "l"), _tokens(right, "r")
    rarity = rt.groupBy("token").agg(F.count("*").alias("freq"))  # one row per character and repeat
    shortest, longest = bar / (200.0 - bar), (200.0 - bar) / bar
    lengths = right.select(F.length("r").alias("other")).distinct()

    def prefixed(tokens, name, other_lengths):
        order = Window.partitionBy(name).orderBy(F.coalesce("freq", F.lit(0)), "token")
        ranked = tokens.join(rarity, "token", "left").withColumn("at", F.row_number().over(order))
        with_other = ranked.withColumn("other", F.explode(other_lengths))
        keep = F.col("length") - _overlap_needed(F.col("length"), F.col("other"), bar) + 1
        return with_other.filter(F.col("at") <= keep)

    def span(length):
        low = F.ceil(length * shortest - 1e-9).cast("int")
        high = F.floor(length * longest + 1e-9).cast("int")
        return F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, low, F.lit(1)))

    lp = prefixed(lt, "l", span(F.col("length"))).select("l", "token", F.col("length").alias("ll"), F.col("other").alias("rl"))
    lp = lp.join(lengths.withColumnRenamed("other", "rl"), "rl", "left_semi")
    rp = prefixed(rt, "r", span(F.col("length"))).select("r", "token", F.col("other").alias("ll"), F.col("length").alias("rl"))
    return lp.join(_large(rp), ["token", "ll", "rl"]).select("l", "r").distinct()


def _without(text: Column) -> Column:
    """All strings left when one character of ``text`` is dropped."""
    return F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )


def _shortened(names: DataFrame, name: str, others: DataFrame, other: str, drops: int) -> DataFrame:
    """The columns of ``names`` and ``part``: the name with 0 to ``drops`` characters dropped, as far as
    the other side has a name from which so many dropped characters leave a string of that length. Their
    number depends on the length of the name only, so this grows linearly with the names."""
    own = names.select(F.length(name).alias("_own")).distinct()
    lengths = others.select(F.length(other).alias("_other")).distinct()
    missing = F.col("_other") - (F.col("_own") - F.col("_step"))
    steps = (
        own.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(drops))))
        .join(F.broadcast(lengths), missing.between(0, drops))  # one row per length
        .groupBy("_own").agg(F.collect_set("_step").alias("_steps"))
    )
    levels = [F.array(F.col(name))]
    for _ in range(drops):
        longer = F.filter(levels[-1], lambda s: F.length(s) > 1)
        levels.append(F.array_distinct(F.flatten(F.transform(longer, _without))))
    none = F.array().cast("array<string>")
    wanted = F.concat(*[F.when(F.array_contains("_steps", i), parts).otherwise(none) for i, parts in enumerate(levels)])
    fitting = names.withColumn("_own", F.length(name)).join(F.broadcast(steps), "_own")
    return fitting.select(*names.columns, F.explode(wanted).alias("part"))


def _near_matches(left: DataFrame, right: DataFrame, drops: int) -> DataFrame:
    """(l, r, rid, score, limit): best right name among those that share with ``l`` a common
    subsequence from which neither name misses more than ``drops`` characters. ``limit`` is the
    highest score any other name can have. The equi-join on shortened names gives exactly these
    pairs, and the longest shared string is the longest common subsequence."""
    pairs = _shortened(left, "l", right, "r", drops).join(_large(_shortened(right, "r", left, "l", drops)), "part")
    la, lb = F.length("l"), F.length("r")
    score = F.bround(200.0 * F.length("part") / (la + lb)).cast("int")
    best = (
        pairs.select("l", "r", "rid", score.alias("score"))
        .groupBy("l")
        .agg(F.max_by(F.struct("r", "rid", "score"), F.struct("score", -F.col("rid"))).alias("b"))
    )
    # another name misses more characters of l, or has more characters that are not in l
    more = drops + 1
    fewer = F.greatest(la - more, F.lit(0))
    limit = F.greatest(200.0 * fewer / (la + fewer), 200.0 * la / (2 * la + more))
    return best.select("l", "b.*", F.floor(limit + 0.5).alias("limit"))


def match_names(left: DataFrame, right: DataFrame, threshold: int = 75, bars=(88, 82)) -> DataFrame:
    """Best name of ``right(id, name)`` for every row of ``left(id, name)``.

    The best score strictly above ``threshold`` wins, the right row with the smallest id on
    ties; otherwise ('unknown', 0). Returns df1_id, df1_name, df2_id, df2_name.

    Only distinct names are compared, in steps that each settle the names whose best match
    cannot be beaten by a later step: equal names, names that differ by one or two dropped
    characters on either side (all equi-joins), and the rest through falling score bars, the
    last of which is the threshold. No step compares all pairs, and none drops a candidate.
    """
    firsts = right.filter("name is not null").groupBy(F.col("name").alias("r")).agg(F.min("id").alias("rid"))
    firsts = materialize(firsts.filter(F.length("r") > 0), "right-names")
    names = left.select(F.col("name").alias("l")).filter("length(name) > 0").distinct()
    names = materialize(names, "left-names")

    settled = names.join(_large(firsts), F.col("l") == F.col("r")).select("l", "r", "rid")
    if threshold >= 100:
        settled = settled.limit(0)
    names = names.join(_large(firsts), F.col("l") == F.col("r"), "left_anti")
    for step, size in [("drops", 1), ("drops", 2)] + [("bar", b) for b in (*bars, threshold + 1)]:
        if threshold >= 100 or names.isEmpty():
            break
        if step == "drops":
            found = _near_matches(names, firsts, size).filter((F.col("score") > F.col("limit")) & (F.col("score") > threshold))
        elif size <= threshold:
            continue
        else:
            # a rounded score of `size` needs at least size - 0.5
            scored = _candidates(names, firsts.select("r"), size - 0.5).withColumn("score", name_ratio(F.col("l"), F.col("r")))
            found = (
                scored.filter(F.col("score") >= size)
                .join(_large(firsts), "r")
                .groupBy("l")
                .agg(F.max_by(F.struct("r", "rid"), F.struct("score", -F.col("rid"))).alias("b"))
                .select("l", "b.*")
            )
        found = materialize(found.select("l", "r", "rid"), "matches")
        settled = settled.unionByName(found)
        names = materialize(names.join(_large(found), "l", "left_anti"), "open-names")
    named = left.join(_large(settled), F.col("name") == F.col("l"), "left")
    return named.select(
        F.col("id").alias("df1_id"),
        F.col("name").alias("df1_name"),
        F.coalesce("rid", F.lit(0)).cast("long").alias("df2_id"),
        F.coalesce("r", F.lit("unknown")).alias("df2_name"),
    )


# --- games ------------------------------------------------------------------------------


def match_games(games: DataFrame, other_games: DataFrame, teams_map: DataFrame) -> DataFrame:
    """(game_id, other_game_id): the other provider's first game with the same mapped teams,
    competition and season. ``teams_map(team_id, other_team_id)``."""

    def mapped(side):
        return teams_map.select(
            F.col("team_id").alias(f"{side}_team_id"), F.col("other_team_id").alias(f"other_{side}")
        )

    keys = ["other_home", "other_away", "competition_id", "season_id"]
    first = (
        other_games.select(
            F.col("home_team_id").alias("other_home"), F.col("away_team_id").alias("other_away"),
            "competition_id", F.col("season_id").cast("string").alias("season_id"), "game_id",
        )
        .groupBy(*keys)
        .agg(F.min("game_id").alias("other_game_id"))
    )
    return (
        games.withColumn("season_id", F.col("season_id").cast("string"))
        .join(mapped("home"), "home_team_id")
        .join(mapped("away"), "away_team_id")
        .join(first, keys)
        .select("game_id", "other_game_id")
    )


# --- shots ------------------------------------------------------------------------------

_ORDER = ["_time", "_side", "_id"]


def _neighbours(rows: DataFrame, keys, order) -> DataFrame:
    """For every row the last right row before it and the first one after it."""
    r = F.when(F.col("_side") == 0, F.col("_right"))
    upto = Window.unboundedPreceding, 0
    forward = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
    backward = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(*upto)
    return rows.withColumns(
        {"_prev": F.last(r, ignorenulls=True).over(forward), "_next": F.last(r, ignorenulls=True).over(backward)}
    )


def _neighbours_hot(rows: DataFrame, keys) -> DataFrame:
    """The same for hot keys: chunk by chunk, with the border rows of other chunks carried."""
    pieces = materialize(chunked(rows, keys, _ORDER), "chunks")
    near = _neighbours(pieces, [*keys, "_chunk"], [POS])
    # one row per chunk
    chunks = pieces.groupBy(*keys, "_chunk").agg(
        F.max_by("_right", F.when(F.col("_side") == 0, F.col(POS))).alias("_last"),
        F.min_by("_right", F.when(F.col("_side") == 0, F.col(POS))).alias("_first"),
    )
    others = Window.unboundedPreceding, -1
    forward = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*others)
    backward = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(*others)
    carried = chunks.select(
        *keys, "_chunk",
        F.last("_last", ignorenulls=True).over(forward).alias("_before"),
        F.last("_first", ignorenulls=True).over(backward).alias("_after"),
    )
    return near.join(carried, [*keys, "_chunk"]).withColumns(
        {"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}
    ).drop(POS, "_chunk", "_before", "_after")


def nearest_in_time(
    left: DataFrame, right: DataFrame, keys, tolerance: float, hot: DataFrame | str | None = "count"
) -> DataFrame:
    """For every left row the right row with equal ``keys`` and the nearest ``time_seconds``, if
    it is nearer than ``tolerance``; the smallest action_id on ties. A right row may serve many.

    Both sides are sorted together and each left row looks at its two neighbours, so that no
    pairs are formed whatever the number of rows with equal keys. ``left`` has a unique ``_id``.
    Returns the left columns and the struct ``match`` (NULL without a match).
    """
    # of right rows at the same time only the first can win
    fields = [c for c in right.columns if c not in (*keys, "time_seconds", "action_id")]
    firsts = right.groupBy(*keys, "time_seconds").agg(
        F.min_by(F.struct("action_id", "time_seconds", *fields), "action_id").alias("_right")
    )
    payload = F.struct(*[c for c in left.columns if c not in keys])
    rows = left.select(
        *keys, F.col("time_seconds").alias("_time"), F.lit(1).alias("_side"), F.col("_id"), payload.alias("_left"),
        F.lit(None).cast(firsts.schema["_right"].dataType).alias("_right"),
    ).unionByName(
        firsts.select(
            *keys, F.col("time_seconds").alias("_time"), F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("_id"), "_right"
        ).withColumn("_left", F.lit(None).cast(left.select(payload.alias("p")).schema["p"].dataType))
    )
    if isinstance(hot, str):
        hot = hot_keys(rows, keys)
    if hot is None:
        near = _neighbours(rows, keys, _ORDER)
    else:
        cold, wide = split_hot(rows, hot)
        near = _neighbours(cold, keys, _ORDER).unionByName(_neighbours_hot(wide, keys))
    shots = near.filter("_side = 1")

    def gap(side):
        return F.abs(F.col("_time") - F.col(f"{side}.time_seconds"))

    nearer = F.col("_next").isNotNull() & (
        F.col("_prev").isNull()
        | (gap("_next") < gap("_prev"))
        | ((gap("_next") == gap("_prev")) & (F.col("_next.action_id") < F.col("_prev.action_id")))
    )
    shots = shots.withColumn("match", F.when(nearer, F.col("_next")).otherwise(F.col("_prev")))
    accepted = F.abs(F.col("_time") - F.col("match.time_seconds")) < tolerance
    return shots.select(*keys, "_left.*", F.when(accepted, F.col("match")).alias("match"))


def match_shots(
    shots: DataFrame, games: DataFrame, other_shots: DataFrame, other_games: DataFrame,
    teams_map: DataFrame, players_map: DataFrame | None = None, tolerance: float = 3.0,
    hot: DataFrame | str | None = "count",
) -> DataFrame:
    """Match shots (game_id, action_id, period_id, player_id, time_seconds) of two providers.

    A shot matches the nearest one in time in the same game and period, and by the same player
    when ``players_map(player_id, other_player_id)`` is given, within ``tolerance`` seconds.
    Returns game_id, action_id, other_game_id, other_action_id; shots without a match are left out.
    """
    keys = ["other_game_id", "period_id"]
    left = shots.join(match_games(games, other_games, teams_map), "game_id")
    right = other_shots.withColumnRenamed("game_id", "other_game_id")
    if players_map is not None:
        keys = [*keys, "other_player_id"]
        left = left.join(players_map, "player_id")
        right = right.withColumnRenamed("player_id", "other_player_id")
    left = left.select(*keys, "game_id", "action_id", "time_seconds", F.xxhash64("game_id", "action_id").alias("_id"))
    right = right.select(*keys, "action_id", "time_seconds")
    matched = nearest_in_time(left, right, keys, tolerance, hot)
    return matched.filter("match is not null").select(
        "game_id", "action_id", "other_game_id", F.col("match.action_id").alias("other_action_id")
    )
