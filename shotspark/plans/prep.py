"""Preprocessing pipelines. Their fitted stages are Spark ML's own, so that fitted pipelines
can be saved and loaded without code of this package.

Estimators of this package only choose parameters in ``fit`` and return such stages.
"""

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import functions as F


def _select(expressions: dict) -> SQLTransformer:
    columns = ", ".join(f"{text} AS `{name}`" for name, text in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def _text(column: str) -> str:
    return f"coalesce(cast(`{column}` as string), 'nan')"


def _number(column: str) -> str:
    return f"nanvl(cast(`{column}` as double), cast(null as double))"


class MeanScale(Estimator):
    """Missing numbers to the training mean, then to mean 0 and population deviation 1.
    Adds ``<column>__z``."""

    def __init__(self, columns):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df):
        clean = df.select(*[F.expr(_number(c)).alias(c) for c in self.columns])
        stats = [
            s
            for c in self.columns
            for s in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"), F.count(c).alias(f"n_{c}"))
        ]
        row = clean.agg(F.count(F.lit(1)).alias("rows"), *stats).first()
        scaled = {}
        for c in self.columns:
            mean = row[f"m_{c}"] or 0.0
            # imputed rows sit at the mean and shrink the variance
            variance = (row[f"v_{c}"] or 0.0) * row[f"n_{c}"] / max(row["rows"], 1)
            deviation = variance**0.5 or 1.0
            scaled[f"{c}__z"] = f"(coalesce({_number(c)}, {mean!r}D) - {mean!r}D) / {deviation!r}D"
        return _select(scaled)


class OrdinalCodes(Estimator):
    """Frequency rank of each value; rare -1, missing -2, not seen -3. Adds ``<column>__o``. The
    fitted stage holds its values, as a stored pipeline has to, so more than ``max_levels`` are
    an error; ``encoders.OrdinalEncoder`` keeps any number in a table."""

    def __init__(self, columns, min_support: int = 5, max_levels: int = 100_000):
        super().__init__()
        self.columns, self.min_support, self.max_levels = list(columns), min_support, max_levels

    def _fit(self, df):
        stages = []
        for c in self.columns:
            counts = df.groupBy(F.expr(_text(c)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
            levels = [(r["value"], r["n"]) for r in counts.limit(self.max_levels + 1).collect()]
            if len(levels) > self.max_levels:
                raise ValueError(f"{c} has more than {self.max_levels} values; encode it as a table first")
            frequent = sum(n >= self.min_support for _, n in levels)
            index = StringIndexerModel.from_labels(
                [v for v, _ in levels], inputCol=f"{c}__s", outputCol=f"{c}__i", handleInvalid="keep"
            )
            code = (
                f"case when `{c}__s` = 'nan' then -2D when `{c}__i` < {frequent} then `{c}__i` "
                f"when `{c}__i` < {len(levels)} then -1D else -3D end"
            )
            stages += [_select({f"{c}__s": _text(c)}), index, _select({f"{c}__o": code})]
        return PipelineModel(stages)


def _checked(numeric, categoric):
    if not numeric and not categoric:
        raise ValueError("both variable lists are empty")
    return list(numeric), list(categoric)


def prep_tree(numeric, categoric, output: str = "features") -> Pipeline:
    """Ordinal codes of the categorical columns, then the scaled numbers."""
    numeric, categoric = _checked(numeric, categoric)
    stages = []
    if categoric:
        stages.append(OrdinalCodes(categoric))
    if numeric:
        stages.append(MeanScale(numeric))
    names = [f"{c}__o" for c in categoric] + [f"{c}__z" for c in numeric]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol=output)])


def prep_linear(numeric, categoric, output: str = "features") -> Pipeline:
    """Indicators of the values of the categorical columns, then the scaled numbers."""
    numeric, categoric = _checked(numeric, categoric)
    stages = []
    if categoric:
        text, index, hot = ([f"{c}__{k}" for c in categoric] for k in "sih")
        stages += [
            _select({f"{c}__s": _text(c) for c in categoric}),
            StringIndexer(inputCols=text, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            # the index keeps a slot for unseen values, which the encoder drops
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
    if numeric:
        stages.append(MeanScale(numeric))
    names = [f"{c}__h" for c in categoric] + [f"{c}__z" for c in numeric]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol=output)])
