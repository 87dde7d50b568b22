"""The five stages: prepare, candidates, train, evaluate, predict.

Each stage's result is a table under the work folder, named by a key of what it
was made from, so a stage runs once.  Keys form a chain: a stage's key is made
of its parents' keys and of all settings that it reads itself (``KEYS``).
Country is the outer key everywhere, as links never cross countries.
"""

from __future__ import annotations

from dataclasses import asdict, is_dataclass

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import fixed_values as fixed
from ..functions.parsing import normalize_records
from ..functions.vectors import half_precision
from ..operators import blocking, decision, diagnostics, embedding, features, lexicon, model, relational
from ..operators.projector import LEAST_ADDRESS_PAIRS, MOST_TRIPLETS, Projector, train
from ..session import kept
from ..sources import tables

VIEWS = {"name": "text_name", "addr": "text_addr"}


#: What each kind of result depends on: its parents, and its own settings.
KEYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "split": ((), ("holdout", "seed")),
    "lexicon": (("train", "truth", "split"), ()),
    "normalized_train": (("lexicon", "train"), ()),
    "normalized_test": (("lexicon", "test"), ()),
    "embedder_train": (("normalized_train",), ("dim", "buckets", "fit_sample", "seed")),
    "embedder_test": (("normalized_test",), ("dim", "buckets", "fit_sample", "seed")),
    "projector": (("embedder_train", "truth", "split"), ("retrieval", "seed")),
    "candidates_train": (("embedder_train", "projector"), ("retrieval", "projectors")),
    "candidates_test": (("embedder_train", "embedder_test", "projector"), ("retrieval", "projectors")),
    "models": (("candidates_train", "truth", "split"), ("model", "folds", "train_entities", "seed")),
    "evaluation": (("models", "candidates_train", "truth", "split"), ("seed",)),
}


class Linkage:
    """``sample``: train on, and evaluate, so many entities only; their results have keys of their own."""

    def __init__(self, spark: SparkSession, config: Config, sample: int | None = None):
        self.spark, self.config, self.sample = spark, config, sample
        self._keys: dict[str, str] = {}

    def key(self, kind: str) -> str:
        if kind not in self._keys:
            if kind in ("train", "test"):
                parts = [tables.file_state(self.spark, self.config.source(kind, i)) for i in (1, 2, 3)]
            elif kind == "truth":
                parts = tables.file_state(self.spark, self.config.truth)
            else:
                parents, settings = KEYS[kind]
                own = [getattr(self.config, s) for s in settings]
                parts = [*map(self.key, parents), *(asdict(x) if is_dataclass(x) else x for x in own)]
                parts += [tables.NORMALIZER_VERSION] if kind.startswith("normalized") else []
                parts += [self.sample] if kind in ("models", "evaluation") else []
            self._keys[kind] = tables.cache_key(kind, parts)
        return self._keys[kind]

    def path(self, kind: str, *parts: str) -> str:
        name = tables.cache_key(self.key(kind), *parts) if parts else self.key(kind)
        return f"{self.config.work}/{kind}/key={name}"

    # -- sources ---------------------------------------------------------------------------------

    def raw(self, split: str) -> tuple[DataFrame, DataFrame]:
        """Entities, and the pool: sources 2 and 3 together."""
        s1, s2, s3 = (tables.load_source(self.spark, self.config.source(split, i)) for i in (1, 2, 3))
        return s1, s2.unionByName(s3)

    def links(self) -> DataFrame:
        return tables.truth_links(tables.load_truth(self.spark, self.config.truth))

    def split(self) -> DataFrame:
        """``entity_id, split, half`` of the training entities; a function of the id alone."""
        ids = tables.load_source(self.spark, self.config.source("train", 1), ["entity_id"])
        return relational.entity_split(ids, "entity_id", self.config.holdout, self.config.seed)

    def members(self, split: str) -> DataFrame:
        return self.split().where(F.col("split") == split).select(F.col("entity_id").alias("s1_id"))

    # -- prepare ---------------------------------------------------------------------------------

    def lexicon(self) -> dict[str, str]:
        path = self.path("lexicon")
        if not tables.exists(self.spark, path):
            s1, pool = self.raw("train")
            fit = self.links().join(self.members("fit"), "s1_id", "left_semi")
            tables.write_json(self.spark, path, lexicon.learn(lexicon.linked_texts(fit, s1, pool)))
        return tables.read_json(self.spark, path)

    def normalized(self, split: str) -> DataFrame:
        """Records of a split with ``source`` (s1 or pool), by source and country."""

        def make() -> DataFrame:
            s1, pool = self.raw(split)
            both = s1.withColumn("source", F.lit("s1")).unionByName(pool.withColumn("source", F.lit("pool")))
            return normalize_records(both, self.lexicon())

        # The partition column keeps the label as text, whatever it looks like.
        self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        out = tables.cached(self.spark, self.config.work, f"normalized_{split}", self.key(f"normalized_{split}"), make, ["source", "country"])
        return out.withColumn("country", F.coalesce("country", F.lit("")))

    def records(self, split: str, source: str, country: str | None = None) -> DataFrame:
        out = self.normalized(split).where(F.col("source") == source).drop("source")
        return out if country is None else out.where(F.col("country") == country)

    def prepare(self) -> None:
        for split in ("train", "test"):
            self.normalized(split)

    # -- candidates ------------------------------------------------------------------------------

    def embedder(self, split: str, country: str, view: str) -> embedding.Embedder:
        """Fitted on the pool of a country; projectors only fit the embedder they were trained with, so test reuses train's."""
        path = self.path(f"embedder_{split}", country, view)
        if not tables.exists(self.spark, f"{path}/_SUCCESS"):
            texts = relational.retrieval_texts(self.records(split, "pool", country)).where(F.col(VIEWS[view]) != "")
            embedding.fit(texts, VIEWS[view], self.config.dim, self.config.buckets, self.config.fit_sample, self.config.seed).save(self.spark, path)
        return embedding.Embedder.load(self.spark, path)

    def basis(self, split: str, country: str) -> str:
        """The split whose pool a country's embedders are fitted on."""
        known = self.config.projectors and split == "test" and not self.records("train", "pool", country).isEmpty()
        return "train" if known else split

    def vectors(self, split: str, source: str, country: str, projected: bool = True) -> DataFrame:
        """``id, part, name_vec, addr_vec, has_addr`` of a country's records."""
        rows = relational.retrieval_texts(self.records(split, source, country))
        for view, text in VIEWS.items():
            project = self.projector(country, view) if projected and self.config.projectors else None
            rows = embedding.embed(rows, text, self.embedder(self.basis(split, country), country, view), f"{view}_vec", project)
            if source == "s1":
                rows = rows.withColumn(f"{view}_vec", half_precision(F.col(f"{view}_vec")))
        part = relational.partition_key(F.col("state"))
        return rows.select(F.col("entity_id").alias("id"), part.alias("part"), "name_vec", "addr_vec", (F.col("addr_norm") != "").alias("has_addr"))

    def training_triplets(self, country: str) -> DataFrame:
        """True pairs of fit entities with a hard negative each, from candidates without projectors; at most ``MOST_TRIPLETS``."""
        fit = self.links().join(self.members("fit"), "s1_id", "left_semi")
        s1, pool = self.vectors("train", "s1", country, False), self.vectors("train", "pool", country, False)
        linked = fit.join(s1.select(F.col("id").alias("s1_id")), "s1_id", "left_semi").join(pool.select(F.col("id").alias("pool_id")), "pool_id", "left_semi")
        found = relational.triplets(linked, blocking.generate(s1, pool, self.config.retrieval))
        found = found.orderBy(relational.hash_fraction(F.concat("s1_id", F.lit(" "), "positive_id"), self.config.seed), "s1_id", "positive_id").limit(MOST_TRIPLETS)
        for role, side, rows in (("s1", "s1", s1), ("positive", "pool", pool), ("negative", "pool", pool)):
            own = rows.select(F.col("id").alias(f"{role}_id"), *(F.col(c).alias(f"{role}_{c}") for c in ("name_vec", "addr_vec", "has_addr")))
            found = found.join(own, f"{role}_id")
        return found

    def projector(self, country: str, view: str) -> Projector | None:
        """None where a country has no training links, or too few pairs with both addresses."""
        path = self.path("projector", country, view)
        if not tables.exists(self.spark, f"{path}/_SUCCESS"):
            if self.records("train", "s1", country).isEmpty():
                return None
            rows = self.training_triplets(country).orderBy("s1_id", "positive_id")
            if view == "addr":
                rows = rows.where("s1_has_addr and positive_has_addr")
            columns = [f"{role}_{view}_vec" for role in ("s1", "positive", "negative")]
            # Bounded by MOST_TRIPLETS: a fixed sample to fit on, as Arrow columns of floats.
            sample = rows.select(*(F.col(c).cast("array<float>").alias(c) for c in columns)).toArrow()
            if not sample.num_rows or (view == "addr" and sample.num_rows <= LEAST_ADDRESS_PAIRS):
                own = Projector.identity(self.config.dim, seed=self.config.seed)
            else:
                own = train(*(pc.list_flatten(sample[c]).to_numpy().reshape(sample.num_rows, -1) for c in columns), seed=self.config.seed)
            own.save(self.spark, path)
        return Projector.load(self.spark, path)

    def candidates(self, split: str) -> DataFrame:
        def make() -> DataFrame:
            out = None
            for country in tables.countries(self.records(split, "s1")):
                own = blocking.generate(self.vectors(split, "s1", country), self.vectors(split, "pool", country), self.config.retrieval)
                own = own.withColumn("country", F.lit(country))
                out = own if out is None else out.unionByName(own)
            return out

        return tables.cached(self.spark, self.config.work, f"candidates_{split}", self.key(f"candidates_{split}"), make)

    # -- train, evaluate, predict ----------------------------------------------------------------

    def features(self, split: str, candidates: DataFrame) -> DataFrame:
        countries = candidates.select("s1_id", "pool_id", "country")
        return features.build(self.records(split, "s1"), self.records(split, "pool"), candidates).join(countries, ["s1_id", "pool_id"])

    def models(self) -> list:
        path = self.path("models")
        if not tables.exists(self.spark, f"{path}/done/_SUCCESS"):
            self.train()
        return model.load(path, self.config.folds)

    def train(self) -> dict[str, float]:
        """Fold models over a sample of fit entities' candidates; returns the features' importances."""
        path = self.path("models")
        fit = relational.exact_sample(self.members("fit"), "s1_id", self.sample or self.config.train_entities, self.config.seed)
        chosen = self.candidates("train").join(fit, "s1_id", "left_semi")
        rows = relational.with_labels(self.features("train", chosen), relational.checked_owners(self.links()))
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        rows = self.spark.read.parquet(f"{path}/rows")
        models, scored = model.cross_validate(rows, fixed.FEATURES, self.config.folds, self.config.model)
        scored.write.mode("overwrite").parquet(f"{path}/oof")
        model.save(models, path)
        found = model.importances(models, fixed.FEATURES)
        tables.write_json(self.spark, f"{path}/done", found)
        return found

    def out_of_fold(self) -> DataFrame:
        self.models()
        return self.spark.read.parquet(f"{self.path('models')}/oof")

    def scores(self, split: str, entities: DataFrame | None = None) -> DataFrame:
        """``s1_id, pool_id, country, prob`` after exclusive assignment; training entities have their out-of-fold probability."""
        chosen = self.candidates(split)
        if entities is not None:
            chosen = chosen.join(entities, "s1_id", "left_semi")
        scored = model.predict_mean(self.models(), self.features(split, chosen)).select("s1_id", "pool_id", "country", "prob")
        if split == "train":
            scored = relational.override(scored, self.out_of_fold())
        return decision.exclusive_assignment(scored)

    def evaluate(self) -> dict:
        """Thresholds from one half of the held-out entities, scores on the other."""
        held = self.split().where("split = 'holdout'").select(F.col("entity_id").alias("s1_id"), "half")
        if self.sample:
            held = relational.exact_sample(held, "s1_id", self.sample, self.config.seed + 99)
        countries = self.records("train", "s1").select(F.col("entity_id").alias("s1_id"), "country")
        n_links = self.links().groupBy("s1_id").agg(F.count("*").alias("n_true"))
        entities = held.join(countries, "s1_id").join(n_links, "s1_id", "left").fillna(0, ["n_true"])
        # Held-out and fit entities compete for pool records, so all are scored unless a sample is asked for.
        scored = self.scores("train", held.select("s1_id") if self.sample else None).join(held, "s1_id")
        path = self.path("evaluation")
        relational.with_labels(scored, relational.checked_owners(self.links())).write.mode("overwrite").parquet(f"{path}/scored")
        scored = self.spark.read.parquet(f"{path}/scored")
        tune, report = (F.col("half") == half for half in ("tune", "report"))
        thresholds = decision.thresholds_by_country(scored.where(tune), entities.where(tune))
        thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
        thresholds = self.spark.read.parquet(f"{path}/thresholds")
        decided = decision.select_by_country(scored, thresholds)
        decided.select("s1_id", "pool_id", "country", "prob", "label", "selected").write.mode("overwrite").parquet(f"{path}/pairs")
        decided = self.spark.read.parquet(f"{path}/pairs")
        half = decided.join(entities.where(report).select("s1_id"), "s1_id", "left_semi")
        macro = {r["country"]: r["macro_f"] for r in decision.macro_by_country(half, entities.where(report)).collect()}
        held_links = self.links().join(held, "s1_id", "left_semi")
        stats = blocking.blocking_stats(decided, held_links, entities, self.records("train", "pool").count()).first().asDict()
        result = {"macro_f": macro, "blocking": stats, "thresholds": [r.asDict() for r in thresholds.collect()], "entities": entities.count()}
        tables.write_json(self.spark, f"{path}/report", result)
        return result

    def thresholds(self) -> DataFrame:
        report = f"{self.path('evaluation')}/report"
        found = tables.read_json(self.spark, report) if tables.exists(self.spark, f"{report}/_SUCCESS") else self.evaluate()
        rows = [(r["country"], r["tau_singleton"], r["tau_match"], r["delta_prob"]) for r in found["thresholds"]]
        return self.spark.createDataFrame(rows, "country string, tau_singleton double, tau_match double, delta_prob double")

    def predict(self) -> dict:
        """Writes both submission tables of the test split; returns the matches' statistics by country."""
        decided = decision.select_by_country(self.scores("test"), self.thresholds())
        matches = kept(decided.where("selected").select("s1_id", "pool_id"), "matches")
        tables.write_submission(self.records("test", "s1"), self.candidates("test"), matches, self.config.output)
        entities = self.records("test", "s1").select(F.col("entity_id").alias("s1_id"), "country")
        return {r["country"]: r.asDict() for r in diagnostics.match_stats(entities, matches).collect()}


STAGES = ["prepare", "candidates", "train", "evaluate", "predict"]


def run(spark: SparkSession, config: Config, stages: list[str] | None = None, sample: int | None = None) -> dict:
    job, out = Linkage(spark, config, sample), {}
    for stage in stages or STAGES:
        if stage == "candidates":
            for split in ("train", "test"):
                job.candidates(split)
        elif (found := getattr(job, stage)()) is not None:
            out[stage] = found
    return out
