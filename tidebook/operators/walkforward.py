"""Walk-forward splits, grid choice and out-of-sample degradation as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.values import int_div
from tidebook.operators.metrics import best_per_group
from tidebook.operators.series import Series


def _numbered(bars: DataFrame, series: Series) -> DataFrame:
    keys = list(series.keys)
    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return series.number(bars, "_i").join(sizes, keys)


def rolling_splits(
    bars: DataFrame, series: Series, n_splits: int = 4, train_frac: float = 0.6
) -> DataFrame:
    """Contiguous segments, the first ``train_frac`` of each is its train part.

    The last segment takes the remainder; degenerate segments are left out.
    """
    if n_splits < 1:
        raise ValueError("n_splits must be positive")
    rows = _numbered(bars, series)
    seg = F.greatest(int_div(F.col("_n"), n_splits), F.lit(1))
    fold = F.least(int_div(F.col("_i"), seg), F.lit(n_splits - 1))
    start = F.col("fold") * seg
    end = F.when(F.col("fold") == n_splits - 1, F.col("_n")).otherwise(start + seg)
    size = end - start
    cut = F.greatest(F.floor(size * F.lit(train_frac)), F.lit(1))
    return (
        rows.withColumn("fold", fold.cast("long"))
        .where((size >= 2) & (cut < size))
        .withColumn("role", F.when(F.col("_i") - start < cut, "train").otherwise("test"))
        .drop("_i", "_n")
    )


def anchored_splits(bars: DataFrame, series: Series, n_splits: int = 4) -> DataFrame:
    """Expanding train window, the next segment is the test part.

    A row is repeated once per fold that uses it.
    """
    if n_splits < 1:
        raise ValueError("n_splits must be positive")
    rows = _numbered(bars, series)
    seg = F.greatest(int_div(F.col("_n"), n_splits + 1), F.lit(1))
    folds = F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))
    train_end = F.least((F.col("fold") + 1) * seg, F.col("_n"))
    test_end = F.when(F.col("fold") == n_splits - 1, F.col("_n")).otherwise(
        F.least((F.col("fold") + 2) * seg, F.col("_n"))
    )
    usable = (train_end >= 2) & (test_end - train_end >= 1)
    role = F.when(F.col("_i") < train_end, "train").when(F.col("_i") < test_end, "test")
    return (
        rows.withColumn("fold", F.explode(folds))
        .where(usable)
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("_i", "_n")
    )


def choose_in_sample(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best parameters per fold on the train part, with their test score.

    ``scores``: keys, fold, role, combo, params..., score.
    """
    by = [*keys, "fold"]
    best = best_per_group(scores.where(F.col("role") == "train"), by)
    best = best.withColumnRenamed("score", "is_score").drop("role")
    oos = scores.where(F.col("role") == "test").select(
        *by, "combo", F.col("score").alias("oos_score")
    )
    return best.join(oos, [*by, "combo"], "left")


#: The window of all rows, on which parameters are chosen at the end: its fold and role.
WHOLE_FOLD, WHOLE_ROLE = -1, "all"


def with_whole(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Fold parts and, as one more window, all ``rows``: one pass scores both."""
    whole = rows.withColumns({"fold": F.lit(WHOLE_FOLD).cast("long"), "role": F.lit(WHOLE_ROLE)})
    return parts.unionByName(whole.select(*parts.columns))


def refit(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parameters of each key that are best on the window of all rows."""
    return best_per_group(scores.where(F.col("role") == WHOLE_ROLE), list(keys)).drop("fold", "role")


def history(scores: DataFrame, keys: Sequence[str], invalid: Sequence[dict]) -> DataFrame:
    """Every trial on the windows that parameters are chosen on.

    Parameter sets in ``invalid`` can't be run; they score -inf on every window.
    """
    by = [*keys, "fold", "role"]
    chosen_on = scores.where(F.col("role") != "test")
    if not invalid:
        return chosen_on
    names = list(invalid[0])
    kinds = {n: scores.schema[n].dataType for n in names}
    sets = F.array(*[F.struct(*[F.lit(p[n]).cast(kinds[n]).alias(n) for n in names]) for p in invalid])
    failed = chosen_on.select(*by).distinct().select(*by, F.inline(sets)).withColumn("score", F.lit(float("-inf")))
    return chosen_on.select(*by, *names, "score").unionByName(failed)


def degradation(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over finite scores and the relative loss out of sample."""

    def mean(c):
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.avg(F.when(ok, F.col(c)))

    agg = folds.groupBy(*keys).agg(
        mean("is_score").alias("is_mean"),
        mean("oos_score").alias("oos_mean"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    drop = F.when(
        F.col("is_mean") != 0, (F.col("is_mean") - F.col("oos_mean")) / F.abs("is_mean")
    ).otherwise(F.lit(float("nan")))
    return agg.withColumn("degradation", drop)


def cv_scores(scores: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Mean out-of-sample score of each parameter set; -inf without a test fold."""
    oos = F.avg(F.when(F.col("role") == "test", F.col("score")))
    return scores.groupBy(*keys, *params).agg(
        F.coalesce(oos, F.lit(float("-inf"))).alias("cv_score")
    )


def objective_scores(
    windows: DataFrame,
    keys: Sequence[str],
    params: Sequence[dict],
    objective: Callable,
    order: str,
) -> DataFrame:
    """Score a user objective on every (keys, fold, role, parameter set).

    ``objective(params, pandas window) -> float``.  A window is one task's
    input by the contract of a free-form objective; use the relational scores
    for windows longer than a task can hold.
    """
    names = sorted(params[0])
    sets = [
        F.struct(
            F.lit(i).cast("long").alias("combo"), *[F.lit(float(p[n])).alias(n) for n in names]
        )
        for i, p in enumerate(params)
    ]
    group = [*keys, "fold", "role", "combo", *names]
    spread = windows.select("*", F.inline(F.array(*sets)))
    schema = T.StructType(
        [spread.schema[g] for g in group] + [T.StructField("score", T.DoubleType())]
    )

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        head = pdf.iloc[[0]][group].reset_index(drop=True)
        head["score"] = float(objective({n: head[n].iloc[0] for n in names}, pdf))
        return head

    return spread.groupBy(*group).applyInPandas(run, schema)
