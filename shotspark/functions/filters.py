"""Shot filters. A filter maps an accessor of action fields to a boolean column, so the same
filter works on an action table and on the first state of a game state."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotspark.functions.vocab import Vocabulary

SHOT_TYPES = ["shot", "shot_penalty", "shot_freekick"]


def field_of(prefix: str = "", polar=None, vocab: Vocabulary = Vocabulary()):
    """Accessor of action fields: columns of a table, or fields of a struct column. ``polar``
    are columns with distance and angle of the start point, where they have been computed;
    ``vocab`` gives the ids of names."""

    def accessor(name):
        return F.col(f"{prefix}.{name}" if prefix else name)

    accessor.polar = polar
    accessor.vocab = vocab
    return accessor


def is_any(a, kind: str, *names: str) -> Column:
    """Whether the type, result or bodypart has one of the names. Compares ids, so the condition
    reaches the scan of a stored table."""
    levels = a.vocab.levels(kind)
    return a(f"{kind}_id").isin(*[levels.index(n) for n in names if n in levels])


def _counted(a) -> Column:
    return is_any(a, "result", "fail", "success")


def any_shot(a) -> Column:
    """All shot kinds; own goals and offside do not count."""
    return is_any(a, "type", *SHOT_TYPES) & _counted(a)


def openplay(a) -> Column:
    return is_any(a, "type", "shot") & _counted(a)


def penalty(a) -> Column:
    return is_any(a, "type", "shot_penalty")


def freekick(a) -> Column:
    return is_any(a, "type", "shot_freekick")
