"""The news pipeline as one micro-batch step: articles in, keyed tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import scalars, timeparse
from eventide.operators import asof, condense, features, labels, ml, state, tagging
from eventide.sources.tables import KeyedTable
from eventide.streaming.offhours import OffHours, bias_signals

Scorer = Callable[[DataFrame], DataFrame]
KEYS = ("article_id", "symbol")


@dataclass
class NewsPipeline:
    """Articles are deduplicated, tagged, condensed, scored, joined to bars, labelled and predicted.

    ``scorer`` adds sentiment, confidence and the three probabilities from ``condensed_text``.
    ``predictor`` (optional) turns feature rows into signals: columns ``KEYS``, ``predicted_signal`` and
    what else it knows; ``model_predictor`` scores with the last deployed model. Rows that arrive off
    hours wait in ``OffHours`` and are shown with a bias of their sentiment until the market is open.
    ``bars`` may be a function that reads the bar table, so that each batch sees new bars. ``as_of``
    is the time of a row, by default when it was scraped, so a replayed batch gives the same rows.

    Every stage stores its rows under the batch number, so a replayed batch changes nothing, and
    the next stage reads the stored rows: lineage stays short and a lost executor costs
    one stage at most.
    """

    spark: SparkSession
    root: str
    mapping: DataFrame
    bars: DataFrame | Callable[[], DataFrame]
    scorer: Scorer
    predictor: Scorer | None = None
    as_of: Column = field(default_factory=lambda: timeparse.published_local(F.col("scraped_at").cast("string")))
    lookbacks: tuple[int, ...] = asof.LOOKBACKS

    def table(self, name: str, *keys: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", keys)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Run one batch. Without new tagged articles it still releases what waits for the market."""
        labelled = self.label(batch, batch_id)
        if self.predictor is not None:
            self.predict(labelled, batch, batch_id)

    def label(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The stored labelled rows of a batch; stages without rows end it early."""
        fresh = self.table("articles", "article_id").append_unseen(batch, batch_id, ["scraped_at"])
        if fresh.isEmpty():
            return None
        keywords = tagging.keyword_table(self.mapping, "_row")
        tagged = tagging.tag_articles(fresh, keywords)
        tagged = tagged.withColumnsRenamed({"Symbol": "symbol", "CompanyName": "company_name"})
        tags = self.table("tags", *KEYS).append_unseen(tagged.drop("confidence"), batch_id)
        if tags.isEmpty():
            return None
        wanted = fresh.join(tags.select("article_id").distinct(), "article_id", "left_semi")
        text = F.trim(F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))))
        short = condense.top_sentences(wanted.select("article_id", text.alias("__t")), "article_id", "__t")
        scored = self.scorer(short.select("article_id", "condensed_text"))
        sentiment = tags.join(scored, "article_id")
        stored = self.table("sentiment", *KEYS).append_unseen(sentiment, batch_id)
        rows = features.text_features(stored.withColumn("as_of", self.as_of), F.col("as_of"))
        bars = self.bars() if callable(self.bars) else self.bars
        enriched = features.with_market(rows, bars, lookbacks=self.lookbacks)
        tag = labels.label_return(F.col("return_15m"))
        return self.table("labels", *KEYS).append_unseen(enriched.withColumns(tag), batch_id)

    @property
    def off_hours(self) -> OffHours:
        return OffHours(self.spark, f"{self.root}/off_hours", KEYS, "as_of")

    def predict(self, labelled: DataFrame | None, batch: DataFrame, batch_id: int) -> None:
        """Signals of the rows whose time has come, with the texts of their articles."""
        ready = self.off_hours.step(labelled, batch_id, batch.select(self.as_of.alias("as_of")))
        if ready is None:
            return
        said = self.predictor(ready).drop("condensed_text", "full_content", "url", "source")
        taken = [c for c in ("headline", "published_time", "company_name", "sentiment", "sentiment_score", "confidence", "as_of") if c not in said.columns]
        rows = said.alias("b").join(ready.alias("k"), state.same_keys("b", "k", KEYS)).select("b.*", *[f"k.{c}" for c in taken])
        shown = F.concat(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), F.lit(" IST"))
        rows = rows.withColumn("predicted_at", shown).drop("as_of")
        self.table("signals", *KEYS).upsert(state.enriched(rows, self.sentiments(batch_id), self.articles(batch_id)), batch_id)

    def _new_and_all(self, name: str, batch_id: int) -> list[DataFrame]:
        rows = self.table(name, *KEYS).read(before=batch_id + 1)
        return [rows.filter(F.col("batch") == batch_id), rows.filter(F.col("batch") < batch_id)]

    def sentiments(self, batch_id: int) -> list[DataFrame]:
        """This batch's scored texts, then all earlier ones."""
        return [t.select("article_id", "headline", "source", "condensed_text", "batch") for t in self._new_and_all("sentiment", batch_id)]

    def articles(self, batch_id: int) -> list[DataFrame]:
        return [t.select("article_id", "source", "content", "url", "batch") for t in self._new_and_all("articles", batch_id)]

    def overnight(self) -> DataFrame | None:
        """Bias signals of the rows that wait for the market, with the texts of their articles; None before the first batch."""
        rows = self.off_hours.pending()
        if rows is None:
            return None
        last = 1 << 62
        picked = ("headline", "published_time", "sentiment", "sentiment_score", "confidence", "as_of")
        return state.enriched(bias_signals(rows.select(*KEYS, *picked), "as_of"), self.sentiments(last), self.articles(last)).drop("as_of")

    def train(self, version: str, names: list[str], force: bool = False, **shape: int) -> tuple[bool, str]:
        """Retrain on all stored labels: (deployed, reason). The run is stored whether it is deployed or not.

        Rows without a readable time are left out; too few rows train nothing.
        """
        held = self.table("labels", *KEYS).read()
        if held is None:
            return False, "no_data"
        rows = held.withColumn("event_ts", timeparse.published_local(F.col("published_time"))).drop("batch")
        previous = self._last_run()
        model, run, reason = ml.retrain(rows, names, "event_ts", list(KEYS), version, previous=previous, force=force, **shape)
        if model is None:
            return False, reason
        ml.save_run(model, run, f"{self.root}/models", f"{self.root}/model_runs", version)
        deployed = self.spark.read.parquet(f"{self.root}/model_runs").filter(F.col("model_version") == version).first().deployed
        return deployed, reason if deployed else "metrics_worse"

    def _last_run(self) -> dict | None:
        try:
            runs = self.spark.read.parquet(f"{self.root}/model_runs")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        run = ml.latest_run(runs).first()
        return run and run.validation_metrics.asDict()

    def model_predictor(self, names: list[str]) -> Scorer:
        """A predictor by the last deployed model; rows with features that are missing or no numbers get no signal."""

        def predict(rows: DataFrame) -> DataFrame:
            found = self._last_run() and ml.deployed_model(self.spark, f"{self.root}/models", f"{self.root}/model_runs")
            if not found:
                return rows.limit(0).select(*KEYS, F.lit(None).cast("string").alias("predicted_signal"))
            version, model = found
            out = ml.score_reaction(model, rows, names)
            return out.select(*KEYS, "predicted_signal", "signal_confidence", "buy_prob", "sell_prob", "hold_prob", F.lit(version).alias("model_version"))

        return predict

    def skipped(self, names: list[str]) -> DataFrame | None:
        """Stored rows that a model cannot score, with the features that are missing or no numbers."""
        rows = self.table("labels", *KEYS).read()
        if rows is None:
            return None
        named = scalars.invalid_names({n: F.col(n) for n in names})
        return rows.select(*KEYS, named.alias("missing")).filter(F.size("missing") > 0).withColumn("skip_reason", F.lit("missing_features"))

    def start(self, articles: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Run on a stream of articles; the default trigger is the five-minute cadence."""
        writer = articles.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "5 minutes"})).start()

    def signals(self, raw: DataFrame | None = None) -> DataFrame | None:
        """Latest signal per key, repaired from the raw articles when given."""
        latest = self.table("signals", *KEYS).latest()
        return latest if latest is None or raw is None else state.repair(latest, raw)
