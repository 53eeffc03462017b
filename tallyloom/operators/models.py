"""Small models with Spark's ML: category classifier, rate regressor, confidence calibration."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, IndexToString, NGram, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import Tables
from . import enrich


#: Points that a forest learns from, beyond which equal rows share one, and the parts they are spread over.
POINTS, PARTS = 200_000, 32


def train_categories(
    rows: DataFrame, text: str = "description", label: str = "category", trees: int = 100, words: int = 1000, depth: int = 10,
    seed: int = 42, pairs: bool = True, balanced: bool = True
) -> PipelineModel:
    """TF-IDF of words and word pairs, and a forest with balanced class weights.

    Terms are counted over all rows. The forest learns from points: rows of equal terms and label, as many as make POINTS
    points at most besides one or two of each kind, joined to a point of their whole weight. No row is left out; up to POINTS rows each is its own point.
    """
    rows = Tables(rows.sparkSession).keep(rows.select(text, label))  # read by every step
    sizes = rows.groupBy(label).agg(F.count("*").alias("\0n")).withColumn(
        "weight",
        F.lit(1.0) if not balanced else F.sum("\0n").over(W.partitionBy()) / (F.col("`\0n`") * F.count("*").over(W.partitionBy()))
    )
    weighted = rows.join(F.broadcast(sizes.select(label, "weight")), label)  # one row a class
    # Class weights: windows over one row a class, of which there are few.
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\s+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement=f"SELECT *, {'concat(words, pairs)' if pairs else 'words'} AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=words, minDF=2, maxDF=0.95),
        IDF(inputCol="counts", outputCol="features"),
    ]
    marked = index.transform(weighted)
    terms = Pipeline(stages=steps).fit(marked)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", seed=seed)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel([*terms.stages, forest.fit(_points(terms.transform(marked))), names])


def _points(rows: DataFrame, points: int = POINTS, parts: int = PARTS) -> DataFrame:
    """(features, label, weight) of equal rows joined, spread over tasks whatever the files' cut; weights add up to the rows'."""
    kinds = Tables(rows.sparkSession).keep(rows.groupBy("features", "label", "weight").agg(F.count("*").alias("n")))
    size = -(-(kinds.agg(F.sum("n")).first()[0] or 0) // points) or 1
    many = F.greatest(F.ceil(F.col("n") / size), F.least(F.col("n"), F.lit(2)))  # two rows may be a leaf, and so may two points
    cut = kinds.withColumn("many", many).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "many")).alias("k"))
    held = F.floor(F.col("n") / F.col("many")) + (F.col("k") <= F.col("n") % F.col("many")).cast("int")
    hashed = F.xxhash64("features", "label")
    return cut.withColumn("weight", F.col("weight") * held).select("features", "label", "weight", "k", hashed.alias("h")).repartition(parts, "h", "k").sortWithinPartitions("h", "k").drop("h", "k")


def predict_categories(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with `predicted`."""
    return model.transform(rows).select(*rows.columns, "predicted")


def train_second(rows: DataFrame, **how) -> PipelineModel:
    """The other category model: single words and 200 trees, classes by their own weight."""
    return train_categories(rows, **({"trees": 200, "pairs": False, "balanced": False} | how))


def split(rows: DataFrame, key: str, held: float = 0.2, seed: int = 42, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows by a hash of their key: equal keys stay together and reruns agree.

    With a label every class gives its share: the rows up to the quantile of the class's own
    hashes (an aggregate of bounded size), so no class is ordered; one of a single row is trained on.
    """
    hashed = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**40))
    if label is None:
        part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(held * 10_000)
        return rows.filter(~part), rows.filter(part)
    limits = rows.groupBy(F.col(label).alias("\0class")).agg(F.when(F.count("*") > 1, F.percentile_approx(hashed, held, 100_000)).alias("\0limit"))
    marked = rows.join(F.broadcast(limits), F.col(label).eqNullSafe(F.col("`\0class`")))  # one row a class
    part = F.coalesce(hashed <= F.col("`\0limit`"), F.lit(False))
    return marked.filter(~part).select(rows.columns), marked.filter(part).select(rows.columns)


def held_out_accuracy(rows: DataFrame, key: str, text: str = "description", label: str = "category", **how) -> float:
    """Share of held-out rows, of each class alike, that a model of the others gets right; null without such rows."""
    train, test = split(rows, key, label=label)
    found = predict_categories(train_categories(train, text, label, **how), test)
    return found.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def cross_validated(rows: DataFrame, key: str, folds: int = 5, text: str = "description", label: str = "category", **how) -> list[float]:
    """Accuracy on each of `folds` parts by a hash of the key, learned from the others."""
    part = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(folds))
    out = []
    for k in range(folds):
        model = train_categories(rows.filter(part != k), text, label, **how)
        out.append(predict_categories(model, rows.filter(part == k)).agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0])
    return out


def train_outputs(rows: DataFrame, labels: Sequence[str], text: str = "description", missing: str = "UNKNOWN", **how) -> dict[str, PipelineModel]:
    """A model for each label; a missing label is a class of its own."""
    known = rows.fillna(missing, list(labels))
    return {label: train_categories(known, text, label, **how) for label in labels}


def predict_outputs(found: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with `predicted_<label>` of each model."""
    for label, model in found.items():
        rows = predict_categories(model, rows).withColumnRenamed("predicted", f"predicted_{label}")
    return rows


def importances(model: PipelineModel, k: int = 10) -> list[tuple[str, float]]:
    """The k terms that weigh most in a category model, with their importance; equals in order of their names."""
    terms = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    weights = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel)).featureImportances
    return sorted(((t, float(w)) for t, w in zip(terms, weights.toArray(), strict=True) if w > 0), key=lambda x: (-x[1], x[0]))[:k]


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """Writes a model and reads it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def enriched(
    rows: DataFrame, categories: PipelineModel | None = None, cities: DataFrame | None = None, sure: float = 0.1, rates: RateModel | None = None
) -> DataFrame:
    """rows with what models fill in: category where empty (and the row's confidence up by `sure` of the
    model's probability, 1 at most), city where empty, and the rate and dollars of foreign rows without a rate:
    the rate model's (predict_rates), without one the amounts' or the usual."""
    none = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    out = rows
    if categories is not None:
        found = categories.transform(out.withColumn("\0none", none("category"))).withColumn("\0p", F.array_max(vector_to_array("probability")))
        out = found.select(
            *[c for c in rows.columns if c not in ("category", "confidence")], F.when(F.col("`\0none`"), F.col("predicted")).otherwise(F.col("category")).alias("category"),
            F.when(F.col("`\0none`"), F.least(F.col("confidence") + sure * F.col("`\0p`"), F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"),
        )
    if cities is not None:
        found = enrich.cities(out, cities)
        out = found.withColumn("merchant_city", F.when(none("merchant_city"), F.col("found_city")).otherwise(F.col("merchant_city"))).drop("found_city", "found_merchant")
    foreign = ~F.coalesce("currency", F.lit("")).isin("", "BRL") & (F.coalesce("fx_rate", F.lit(0)) == 0)
    if rates is not None:
        out = rates.predict(out).drop("sure").withColumnRenamed("predicted_rate", "\0rate")
    else:
        out = out.withColumn("\0rate", enrich.rate(F.col("amount_brl"), F.col("amount_orig"), F.col("currency")))
    rate = F.when(foreign, F.col("`\0rate`")).otherwise(F.col("fx_rate").cast("double"))
    usd = F.when(
        foreign & (F.coalesce("amount_usd", F.lit(0)) == 0), F.round(F.try_divide(F.col("amount_brl").cast("double"), rate), 2)
    ).otherwise(F.col("amount_usd").cast("double"))
    return out.withColumns({"amount_usd": usd, "fx_rate": rate}).select(*rows.columns)


def train_all(golden: DataFrame, path: str, key: str = "idx", rate_rounds: int = 100, **how) -> DataFrame:
    """Trains and stores the category model, the rate model (where there are rates enough) and the vocabularies of cities and
    merchants; one row of what was learned: rows, cities, merchants, and the rates' rows and held-out errors."""
    model = train_categories(golden, **how)
    model.write().overwrite().save(f"{path}/categories")
    enrich.known_cities(golden).write.mode("overwrite").parquet(f"{path}/cities")
    enrich.known_merchants(golden).write.mode("overwrite").parquet(f"{path}/merchants")
    spark = golden.sparkSession
    count = lambda n: spark.read.parquet(f"{path}/{n}").count()
    rates, learned = None, (0, None, None)
    if {"fx_rate", "currency", "amount_orig", "date"} <= set(golden.columns):
        rates, errors = learn_rates(golden, key, rate_rounds)
        if rates is not None:
            rates.model.write().overwrite().save(f"{path}/rates")
            learned = errors["rows"], errors["mae"], errors["r2"]
    made = (golden.count(), count("cities"), count("merchants"), *learned)
    return spark.createDataFrame([made], "rows long, cities long, merchants long, rate_rows long, rate_mae double, rate_r2 double")


#: Features of the rate model, the rows it needs at least, and the largest rate that it learns from.
RATE_FEATURES = [
    "implied_rate", "log_brl", "log_orig", "is_usd", "is_eur", "is_gbp", "year", "month", "day", "quarter", "text_length", "has_paypal", "has_amazon", "has_online"
]
LEAST_RATES, LARGEST_RATE = 10, 20.0


class RateModel(NamedTuple):
    """A trained rate regressor and the mean rate of each currency that it was learned from."""

    model: PipelineModel
    means: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted_rate and sure; rows that lack a feature keep their place, with 0 for it."""
        found = predict_rates(self.model, _featured(rows), self.means)
        return found.select(*rows.columns, "predicted_rate", "sure")


def _featured(rows: DataFrame) -> DataFrame:
    made = enrich.rate_features(rows)
    return made.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RATE_FEATURES})


def learn_rates(rows: DataFrame, key: str = "idx", rounds: int = 100, least: int = LEAST_RATES) -> tuple[RateModel | None, dict]:
    """(model, errors): learned from the foreign rows with a plausible rate, a fifth of them held out; None if they are fewer than `least`.

    errors: rows learned from, and `mae` and `r2` of the held-out rows.
    """
    rate = F.col("fx_rate").cast("double")
    valid = _featured(rows.filter(~F.coalesce("currency", F.lit("")).isin("", "BRL") & (rate > 0) & (rate < LARGEST_RATE))).withColumn("fx_rate", rate)
    if valid.limit(least).count() < least:
        return None, {}
    train, test = split(valid, key)
    model = train_rates(train, RATE_FEATURES, rounds=rounds)
    means = {r.currency: r.m for r in train.filter(F.col("currency").isin(*enrich.RATES)).groupBy("currency").agg(F.avg("fx_rate").alias("m")).collect()}
    return RateModel(model, means), {"rows": train.count(), **rate_errors(model.transform(test))}


def rate_errors(found: DataFrame, label: str = "fx_rate", predicted: str = "prediction") -> dict:
    """Mean absolute error and R2 (1 - squared error / squared deviation from the mean) of predicted rows, in one pass; null without rows or deviation."""
    y, p = F.col(label).cast("double"), F.col(predicted)
    row = found.agg(F.avg(F.abs(p - y)).alias("mae"), F.avg((p - y) * (p - y)).alias("miss"), F.var_pop(y).alias("spread")).first()
    return {"mae": row.mae, "r2": 1 - row.miss / row.spread if row.spread else None}


def train_rates(rows: DataFrame, features: list[str], label: str = "fx_rate", rounds: int = 100, seed: int = 42) -> PipelineModel:
    """Scaled features to a rate by boosted trees."""
    steps = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=5, stepSize=0.1, seed=seed)
    ]
    return Pipeline(stages=steps).fit(rows)


def predict_rates(model: PipelineModel | None, rows: DataFrame, means: dict[str, float] | None = None) -> DataFrame:
    """rows with `predicted_rate` and `sure`: the rate the amounts imply where plausible (.95), else the model's (.7), else the currency's mean or the usual one (.5), within the currency's bounds."""
    low, high = enrich.bounds(F.col("currency"))
    implied = F.try_divide(F.abs("amount_brl"), F.abs("amount_orig")).cast("double")
    plain = F.when(implied.between(low, high), implied)
    found = model.transform(rows) if model else rows.withColumn("prediction", F.lit(None).cast("double"))
    mean = F.lit(None).cast("double")
    for currency, m in (means or {}).items():
        mean = F.when(F.col("currency") == currency, m).otherwise(mean)
    guess = F.coalesce("prediction", enrich.rate(F.col("amount_brl"), F.col("amount_orig"), F.col("currency"), mean))
    sure = F.when(plain.isNotNull(), 0.95).when(F.col("prediction").isNotNull(), 0.7).otherwise(0.5)
    return found.select(*rows.columns, F.coalesce(plain, F.least(F.greatest(guess, low), high)).alias("predicted_rate"), sure.alias("sure"))


def platt(rows: DataFrame, features: Sequence[str], hit: str = "hit", default: float = 0.8) -> DataFrame:
    """rows with `score`, the logistic probability of a hit; the default where there aren't hits and misses."""
    if rows.select(hit).distinct().limit(2).count() < 2:
        return rows.withColumn("score", F.lit(default))
    made = VectorAssembler(inputCols=list(features), outputCol="\0f").transform(rows.withColumn("\0y", F.col(hit).cast("double")))
    model = LogisticRegression(featuresCol="\0f", labelCol="\0y", probabilityCol="\0p", rawPredictionCol="\0r", predictionCol="\0c").fit(made)
    return model.transform(made).select(*rows.columns, F.get(vector_to_array("\0p"), F.lit(1)).alias("score"))


def calibrate(rows: DataFrame, score: str = "confidence", hit: str = "hit") -> DataFrame:
    """rows with `calibrated`, the isotonic share of hits at their score; the score itself below five rows."""
    if rows.limit(5).count() < 5:
        return rows.withColumn("calibrated", F.col(score))
    made = VectorAssembler(inputCols=[score], outputCol="\0s").transform(rows.withColumn("\0y", F.col(hit).cast("double")))
    model = IsotonicRegression(featuresCol="\0s", labelCol="\0y", predictionCol="calibrated").fit(made)
    return model.transform(made).select(*rows.columns, "calibrated")
