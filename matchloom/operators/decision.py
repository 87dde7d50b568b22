"""From probabilities to decisions: exclusive assignment, the gate and its thresholds, F-beta."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed

BETA = 0.5


def exclusive_assignment(scored: DataFrame) -> DataFrame:
    """Each pool record keeps its probability for its best entity; elsewhere it gets 0 but stays a candidate."""
    by = Window.partitionBy("pool_id").orderBy(F.desc("prob"), "s1_id")
    return scored.withColumn("prob", F.when(F.row_number().over(by) == 1, F.col("prob")).otherwise(F.lit(0.0)))


def gate(best: Column, prob: Column, tau_singleton: Column, tau_match: Column, delta: Column) -> Column:
    return (best >= tau_singleton) & (prob >= tau_match) & (best - prob <= delta)


def with_best(scored: DataFrame) -> DataFrame:
    return scored.withColumn("best", F.max("prob").over(Window.partitionBy("s1_id")))


def select_pairs(scored: DataFrame, tau_singleton: float, tau_match: float, delta_prob: float) -> DataFrame:
    """``selected``: whether the gate lets the pair through."""
    return with_best(scored).withColumn("selected", gate(F.col("best"), F.col("prob"), F.lit(tau_singleton), F.lit(tau_match), F.lit(delta_prob))).drop("best")


def select_by_country(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The same with each country's thresholds (``country, tau_singleton, tau_match, delta_prob``), else those of ``default``.

    A row per country: broadcast by its nature, as few countries exist.
    """
    names = ["tau_singleton", "tau_match", "delta_prob"]
    default = F.broadcast(thresholds.where("country = 'default'").select(*(F.col(n).alias(f"d_{n}") for n in names)))
    own = F.broadcast(thresholds.where("country <> 'default'").select("country", *(F.col(n).alias(f"o_{n}") for n in names)))
    joined = with_best(scored).join(own, "country", "left").join(default, how="cross")
    picked = [F.coalesce(f"o_{n}", f"d_{n}") for n in names]
    return joined.withColumn("selected", gate(F.col("best"), F.col("prob"), *picked)).select(*scored.columns, "selected")


def fbeta(tp: Column, predicted: Column, true: Column, beta: float = BETA) -> Column:
    """F-beta of one entity; 1 if it has no links and none is predicted."""
    b2 = beta * beta
    p, r = tp / predicted, tp / true
    return F.when((true == 0) & (predicted == 0), 1.0).when(tp > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0)


def entity_scores(decided: DataFrame, entities: DataFrame, beta: float = BETA) -> DataFrame:
    """``f`` of every entity of ``s1_id, n_true``, also those without candidates; ``decided`` has ``selected, label``."""
    own = decided.where("selected").groupBy("s1_id").agg(F.sum("label").alias("tp"), F.count("*").alias("predicted"))
    joined = entities.join(own, "s1_id", "left").fillna(0, ["tp", "predicted"])
    return joined.withColumn("f", fbeta(F.col("tp"), F.col("predicted"), F.col("n_true"), beta))


def macro_fbeta(decided: DataFrame, entities: DataFrame, beta: float = BETA) -> DataFrame:
    return entity_scores(decided, entities, beta).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f"))


def macro_by_country(decided: DataFrame, entities: DataFrame, beta: float = BETA) -> DataFrame:
    """``country, macro_f`` with rows for ``all`` (entities weigh the same) and ``mean`` (countries do).

    Entities are scored once: sums and counts by country, a few rows, give all others.
    """
    own = entity_scores(decided, entities, beta).groupBy("country").agg(F.sum("f").alias("f"), F.count("*").alias("n"))
    mean = F.sum("f") / F.sum("n")
    total = own.rollup("country").agg(mean.alias("own"), F.avg(F.col("f") / F.col("n")).alias("each"), F.grouping("country").alias("over"))
    named = F.when(F.col("over") == 0, F.array(F.struct("country", F.col("own").alias("macro_f"))))
    both = F.array(F.struct(F.lit("all").alias("country"), F.col("own").alias("macro_f")), F.struct(F.lit("mean").alias("country"), F.col("each").alias("macro_f")))
    return total.select(F.explode(named.otherwise(both)).alias("r")).select("r.country", "r.macro_f")


def set_fbeta(predicted: Column, true: Column, beta: float = BETA) -> Column:
    """F-beta of two arrays of ids."""
    predicted, true = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (predicted, true))
    return fbeta(F.size(F.array_intersect(predicted, true)), F.size(predicted), F.size(true), beta)


def grid(spark) -> DataFrame:
    """All thresholds of the grid whose match threshold isn't above the singleton threshold, numbered in order."""
    points = [(i, ts, tm, dp) for i, (ts, tm, dp) in enumerate((ts, tm, dp) for ts in fixed.TAU_SINGLETON for tm in fixed.TAU_MATCH for dp in fixed.DELTA_PROB if tm <= ts)]
    return spark.createDataFrame(points, "point int, tau_singleton double, tau_match double, delta_prob double")


def _fbeta_array(tp: np.ndarray, predicted: np.ndarray, true: np.ndarray, beta: float) -> np.ndarray:
    b2 = beta * beta
    with np.errstate(divide="ignore", invalid="ignore"):
        p, r = tp / predicted, tp / true
        f = np.where(tp > 0, (1 + b2) * p * r / (b2 * p + r), 0.0)
    return np.where((true == 0) & (predicted == 0), 1.0, f)


def _grid_sums(beta: float):
    """Sums of F-beta at all points over the entities of a task, country by country.

    What an entity's pairs do at a match threshold and a distance doesn't depend
    on the singleton threshold, which only decides whether they count at all.
    """
    singleton, match, delta = (np.array(x) for x in (fixed.TAU_SINGLETON, fixed.TAU_MATCH, fixed.DELTA_PROB))
    allowed = [(i, j, k) for i, ts in enumerate(singleton) for j, tm in enumerate(match) for k in range(len(delta)) if tm <= ts]

    def add(batch, sums: np.ndarray) -> None:
        true = batch.column("n_true").to_numpy(zero_copy_only=False).astype(float)
        prob, label = (batch.column(c) for c in ("p", "y"))
        size = pc.fill_null(pc.list_value_length(prob), 0).to_numpy(zero_copy_only=False)
        bare = _fbeta_array(np.zeros(len(true)), np.zeros(len(true)), true, beta)
        own = np.flatnonzero(size)
        sums += bare[size == 0].sum()
        if not len(own):
            return
        p, y = prob.flatten().to_numpy().astype(float), label.flatten().to_numpy().astype(float)
        starts = np.cumsum(size[own]) - size[own]
        best = np.maximum.reduceat(p, starts)
        passed = (p[:, None, None] >= match[:, None]) & ((np.repeat(best, size[own]) - p)[:, None, None] <= delta)
        predicted = np.add.reduceat(passed.astype(float), starts, axis=0)
        tp = np.add.reduceat(passed * y[:, None, None], starts, axis=0)
        f = _fbeta_array(tp, predicted, true[own][:, None, None], beta)
        for i, ts in enumerate(singleton):
            over = best >= ts
            sums[i] += f[over].sum(axis=0) + bare[own][~over].sum()

    def run(batches):
        sums: dict[str | None, np.ndarray] = {}
        counts: dict[str | None, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                country = batch.column("country")
                for name in country.unique().to_pylist():
                    part = batch.filter(pc.is_null(country) if name is None else pc.equal(country, name))
                    if name not in sums:
                        sums[name], counts[name] = np.zeros((len(singleton), len(match), len(delta))), 0
                    add(part, sums[name])
                    counts[name] += part.num_rows
        for name, own in sums.items():
            points = [own[place] for place in allowed]
            columns = [pa.array([name] * len(points), pa.string()), pa.array(range(len(points)), pa.int32()), pa.array(points, pa.float64()), pa.array([counts[name]] * len(points), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["country", "point", "f", "n"])

    return run


def _grid_rows(scored: DataFrame, entities: DataFrame, beta: float) -> DataFrame:
    """``country, point, f, n``: sums per country and point.

    An entity's candidates come together once, as arrays of at most the cap; a
    task then emits one sum per country and point, and nothing else is shuffled.
    """
    lists = scored.groupBy("s1_id").agg(F.collect_list(F.struct("prob", "label")).alias("c"))
    country = F.col("country") if "country" in entities.columns else F.lit(None).cast("string")
    joined = entities.select("s1_id", "n_true", country.alias("country")).join(lists, "s1_id", "left")
    columns = joined.select("country", F.col("n_true").cast("double").alias("n_true"), F.col("c.prob").alias("p"), F.transform("c.label", lambda y: y.cast("double")).alias("y"))
    return columns.mapInArrow(_grid_sums(beta), "country string, point int, f double, n long")


def _pointed(sums: DataFrame, digits: int) -> DataFrame:
    """Mean scores in place of sums, with the thresholds of each point."""
    points = F.broadcast(grid(sums.sparkSession))
    score = F.round(F.when(F.col("n") > 0, F.col("f") / F.col("n")).otherwise(0.0), digits)
    return sums.join(points, "point").withColumn("score", score).drop("f", "n")


def grid_scores(scored: DataFrame, entities: DataFrame, beta: float = BETA, digits: int = 12) -> DataFrame:
    """``point, tau_singleton, tau_match, delta_prob, score`` of every point of the grid."""
    sums = _grid_rows(scored, entities, beta).groupBy("point").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    return _pointed(sums, digits).select("point", "tau_singleton", "tau_match", "delta_prob", "score")


def best_thresholds(scored: DataFrame, entities: DataFrame, beta: float = BETA) -> DataFrame:
    """One row: the first point of the grid with the best score."""
    return grid_scores(scored, entities, beta).orderBy(F.desc("score"), "point").limit(1)


def thresholds_by_country(scored: DataFrame, entities: DataFrame, beta: float = BETA) -> DataFrame:
    """A ``default`` row over all entities and one for each country, from one pass over the candidates."""
    sums = _grid_rows(scored, entities, beta)
    named = F.when(F.grouping("country") == 1, "default").otherwise(F.col("country"))
    sums = sums.rollup("point", "country").agg(F.sum("f").alias("f"), F.sum("n").alias("n"), named.alias("name")).where("point is not null and name is not null")
    scores = _pointed(sums.select("point", F.col("name").alias("country"), "f", "n"), 12)
    names = ["tau_singleton", "tau_match", "delta_prob", "score"]
    best = scores.groupBy("country").agg(F.max_by(F.struct(*names), F.struct("score", -F.col("point"))).alias("r"))
    return best.select("country", *(F.col(f"r.{c}").alias(c) for c in names))


def id_lists(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.groupBy("s1_id").agg(F.sort_array(F.collect_list("pool_id")).alias(name))
