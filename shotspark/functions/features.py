"""Feature generators.

A generator takes the list of states (shot first, then the actions before it) and returns
named columns. A state is a callable from field name to Column, see ``filters.field_of``.
``simple`` lifts a function of one action to all states and adds the suffixes ``_a0``,
``_a1``, ...; applied to a plain table (one state) it gives the ``_a0`` columns only.
Any function of this shape can be passed as a user generator.
"""

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.functions.filters import field_of
from shotspark.functions.vocab import (
    BOX_LENGTH,
    BOX_WIDTH,
    GOAL_WIDTH,
    LENGTH,
    SIX_YARD_LENGTH,
    SIX_YARD_WIDTH,
    WIDTH,
)

MID = WIDTH / 2


def simple(per_action):
    """Lift ``per_action(a) -> {name: Column}`` to a generator over states."""

    @wraps(per_action)
    def generator(states) -> list[Column]:
        return [
            column.alias(f"{name}_a{i}")
            for i, state in enumerate(states)
            for name, column in per_action(state).items()
        ]

    return generator


def on_table(df: DataFrame, generators, keep=()) -> DataFrame:
    """Apply generators to a plain action table."""
    return df.select(*keep, *[c for g in generators for c in g([field_of()])])


def length_of(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


# --- one action at a time ---------------------------------------------------------------


@simple
def actiontype(a):
    return {"type_id": a("type_id")}


@simple
def bodypart(a):
    return {"bodypart_id": a("bodypart_id")}


@simple
def result(a):
    return {"result_id": a("result_id")}


@simple
def startlocation(a):
    return {"start_x": a("start_x"), "start_y": a("start_y")}


@simple
def endlocation(a):
    return {"end_x": a("end_x"), "end_y": a("end_y")}


@simple
def movement(a):
    dx, dy = a("end_x") - a("start_x"), a("end_y") - a("start_y")
    return {"dx": dx, "dy": dy, "movement": length_of(dx, dy)}


def _polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Distance to the goal centre and absolute angle to its axis."""
    dx, dy = F.lit(LENGTH) - x, F.abs(F.lit(MID) - y)
    on_goal_line = F.when(dy > 0, F.pi() / 2).otherwise(F.when(dy == 0, F.lit(0.0)))
    return length_of(dx, dy), F.when(dx == 0, on_goal_line).otherwise(F.atan(F.try_divide(dy, dx)))


def start_polar_of(a) -> tuple[Column, Column]:
    return getattr(a, "polar", None) or _polar(a("start_x"), a("start_y"))


@simple
def startpolar(a):
    distance, angle = start_polar_of(a)
    return {"start_dist_to_goal": distance, "start_angle_to_goal": angle}


@simple
def endpolar(a):
    distance, angle = _polar(a("end_x"), a("end_y"))
    return {"end_dist_to_goal": distance, "end_angle_to_goal": angle}


@simple
def goalangle(a):
    """Angle under which the goal mouth is seen."""
    x, y = a("start_x"), a("start_y")
    dx, dy, post = F.lit(LENGTH) - x, F.lit(MID) - y, GOAL_WIDTH / 2
    span = dx * dx + dy * dy - post * post
    angle = F.atan(F.try_divide(GOAL_WIDTH * dx, span))
    in_mouth = (x == LENGTH) & y.between(MID - post, MID + post)
    return {
        "shot_angle": F.when(in_mouth, F.pi())
        .when(x >= LENGTH, F.lit(0.0))
        .when(span == 0, F.pi() / 2)
        .when(angle < 0, angle + F.pi())
        .otherwise(angle)
    }


# --- the shot against an earlier action -------------------------------------------------


def _against_earlier(states, build) -> list[Column]:
    return [
        column.alias(name)
        for i, state in enumerate(states[1:], start=1)
        for name, column in build(i, state, states[0]).items()
    ]


def space_delta(states):
    """Way from the end of an earlier action to the start of the shot."""

    def build(i, a, shot):
        dx, dy = a("end_x") - shot("start_x"), a("end_y") - shot("start_y")
        return {f"dx_a0{i}": dx, f"dy_a0{i}": dy, f"mov_a0{i}": length_of(dx, dy)}

    return _against_earlier(states, build)


def team(states):
    """Whether an earlier action was by the shooting team."""
    return _against_earlier(states, lambda i, a, shot: {f"team_{i}": a("team_id") == shot("team_id")})


def time_delta(states):
    return _against_earlier(
        states, lambda i, a, shot: {f"time_delta_{i}": shot("time_seconds") - a("time_seconds")}
    )


def speed(states):
    """Ball speed between an earlier action and the shot, over at least one second."""

    def build(i, a, shot):
        dt = F.greatest(shot("time_seconds") - a("time_seconds"), F.lit(1.0))
        dx, dy = a("end_x") - shot("start_x"), a("end_y") - shot("start_y")
        return {
            f"speedx_a0{i}": F.abs(dx) / dt,
            f"speedy_a0{i}": F.abs(dy) / dt,
            f"speed_a0{i}": length_of(dx, dy) / dt,
        }

    return _against_earlier(states, build)


# --- zones ------------------------------------------------------------------------------


def _digitize(value: Column, edges) -> Column:
    """Number of ascending edges at or below the value."""
    return reduce(lambda n, e: n + (value >= float(e)).cast("int"), edges, F.lit(0))


def _within_levels(zone: Column, levels: int) -> Column:
    return F.when(zone.between(0, levels - 1), zone)


def triangular_grid(name, angle_bins, dist_bins, symmetrical=False):
    """Cells by distance and angle to goal."""

    @simple
    def generator(a):
        distance, angle = start_polar_of(a)
        if symmetrical:
            angle = F.when(angle > F.pi() / 2, angle - F.pi() / 2).otherwise(angle)
        d, t = _digitize(distance, dist_bins), _digitize(angle, angle_bins)
        return {name: _within_levels(d * t + d, len(dist_bins) * len(angle_bins))}

    return generator


def rectangular_grid(name, x_bins, y_bins, symmetrical=False):
    """Cells by x and y."""

    @simple
    def generator(a):
        x, y = a("start_x"), a("start_y")
        if symmetrical:
            y = F.when(y > MID, y - MID).otherwise(y)
        i, j = _digitize(x, x_bins), _digitize(y, y_bins)
        return {name: _within_levels(i * j + j, len(x_bins) * len(y_bins))}

    return generator


def in_rectangle(rect):
    """Zone predicate: closed rectangle (x_min, y_min, x_max, y_max)."""
    x_min, y_min, x_max, y_max = rect
    return lambda x, y: x.between(x_min, x_max) & y.between(y_min, y_max)


def custom_grid(name, zones, is_in_zone=in_rectangle):
    """Numbered zones, each a list of parts; the last zone that holds the point counts and 0
    stands for none. ``is_in_zone(part)(x, y)`` returns a boolean column."""

    @simple
    def generator(a):
        x, y = a("start_x"), a("start_y")
        zone = None
        for number in range(len(zones), 0, -1):
            hit = F.lit(False)
            for part in zones[number - 1]:
                hit = hit | is_in_zone(part)(x, y)
            zone = F.when(hit, number) if zone is None else zone.when(hit, number)
        return {name: F.lit(0) if zone is None else zone.otherwise(0)}

    return generator


def shot_location_zones(fix_zone8=False):
    """The eight zones of the published shot-location matrix, as closed rectangles.

    The left half of zone 8 is empty unless ``fix_zone8`` is set: its bounds are swapped in
    the definition that results have to agree with.
    """

    def strip(near, far, low, high):
        """Rectangle between two distances from the goal line."""
        return (LENGTH - far, low, LENGTH - near, high)

    def both_sides(near, far, inner, outer):
        return [strip(near, far, MID - outer, MID - inner), strip(near, far, MID + inner, MID + outer)]

    post, six, box = GOAL_WIDTH / 2, SIX_YARD_WIDTH / 2, BOX_WIDTH / 2
    byline = SIX_YARD_LENGTH + 2
    upper_flank = strip(0, 32, MID + box, WIDTH) if fix_zone8 else strip(0, 32, WIDTH, MID + box)
    return [
        [strip(0, SIX_YARD_LENGTH, MID - post, MID + post)],
        both_sides(0, SIX_YARD_LENGTH, post, six),
        [strip(SIX_YARD_LENGTH, BOX_LENGTH, MID - six, MID + six)],
        both_sides(byline, BOX_LENGTH, six, box),
        both_sides(0, byline, six, box),
        [strip(BOX_LENGTH, 32, MID - box, MID + box)],
        [strip(32, LENGTH, 0.0, WIDTH)],
        [upper_flank, strip(0, 32, 0.0, MID - box)],
    ]


location_zone = custom_grid("caley_zone", shot_location_zones())

# Edges of the default distance/angle zones
ANGLE_EDGES = [-50, -20, 20, 50]
DISTANCE_EDGES = [2, 4, 8, 11, 16, 24, 34, 50]

all_features = [
    actiontype,
    bodypart,
    result,
    startlocation,
    endlocation,
    movement,
    space_delta,
    startpolar,
    endpolar,
    team,
    time_delta,
    speed,
    goalangle,
    location_zone,
    triangular_grid("angle_zone", ANGLE_EDGES, DISTANCE_EDGES, symmetrical=True),
]
