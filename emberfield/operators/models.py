"""Scorers on Spark ML, fitted and applied as distributed jobs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Imputer, QuantileDiscretizer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.functions.columns import is_score
from emberfield.operators import evaluation as ev
from emberfield.operators import folds
from emberfield.operators.contracts import forbid_leakage, violations
from emberfield.operators.features import BLOCKED
from emberfield.operators.ordering import row_numbers
from emberfield.session import in_parallel, settle, with_row

LABEL = "is_eog_flare"
RULE_DAYS, RULE_ENTROPY = (5, 10, 30, 60), (0.0, 0.5, 0.7)
TREE_ROWS, TREE_DRAWS = 256, 2.0
MOST_FOLDS = 200
MANIFEST = "protocol string, features array<string>, threshold double, holdout string, holdout_seen boolean"


def persistence_rule(df: DataFrame) -> DataFrame:
    """Predictions of the 4 × 3 grid of day and entropy limits, long over ``branch``."""
    grid = F.array(
        *[F.struct(F.lit(d).alias("days"), F.lit(e).alias("entropy")) for d in RULE_DAYS for e in RULE_ENTROPY]
    )
    # Rounded: the entropy of two equal months must reach 0.5-like limits on any engine.
    hit = (F.col("n_days") >= F.col("g.days")) & (F.round(F.col("month_entropy"), 12) >= F.col("g.entropy"))
    name = F.concat(F.lit("n_days>="), F.col("g.days"), F.lit(" & month_entropy>="), F.format_number("g.entropy", 1))
    return df.withColumn("g", F.explode(grid)).select(
        "source_id", "country", LABEL, name.alias("branch"), F.coalesce(hit, F.lit(False)).cast("double").alias("score")
    )


def persistence_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scaled columns as scores, NULL counting as 0, long over ``branch``."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    limits = df.agg(*[f(v).alias(f"_{n}_{c}") for c, v in filled.items() for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = [
        F.struct(
            F.lit(c).alias("branch"),
            ((v - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-9)).alias("score"),
        )
        for c, v in filled.items()
    ]
    return with_row(df, limits).select("source_id", "country", LABEL, F.explode(F.array(*pairs)).alias("p")).select(
        "source_id", "country", LABEL, "p.*"
    )


def _matrix(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def _average_depth(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """One random tree as (feature, cut, left, right, depth) rows; feature -1 marks a leaf."""
    nodes: list[list[float]] = []
    stack = [(rows, 0, -1, 2)]
    while stack:
        part, depth, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][side] = here
        span = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_depth(len(part)))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        nodes.append([feature, cut, -1, -1, 0.0])
        below = part[:, feature] < cut
        stack.append((part[~below], depth + 1, here, 3))
        stack.append((part[below], depth + 1, here, 2))
    return nodes


def _fraction(seed: int, identifier: Column, part: Column | str) -> Column:
    """Portable draw in [0, 1) for an id and a purpose."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), identifier.cast("string"), F.lit(part).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def isolation_rank(df: DataFrame, columns: Sequence[str], trees: int = 300, seed: int = 0) -> DataFrame:
    """Isolation score in [0, 1]: trees grow in parallel on small seeded samples, rows are scored in batches.

    Each tree takes ``TREE_ROWS`` of all rows. One map pass draws about ``TREE_DRAWS``
    times as many for each tree: a row enters as often as a hash of its id says, and a
    hash names the tree each time. Each tree is then cut to size in hash order.
    """
    rows = settle(df.select("source_id", _matrix(df, columns).alias("x")))
    rate = TREE_DRAWS * TREE_ROWS * trees / max(rows.count(), 1)
    times = (F.lit(int(rate)) + (_fraction(seed, F.col("source_id"), "times") < rate % 1).cast("int")).cast("int")
    drawn = rows.where(times > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), times)))
    tree = F.floor(_fraction(seed, F.col("source_id"), F.col("_k")) * trees).cast("int")
    spread = drawn.withColumn("tree", tree).groupBy("tree", "source_id").agg(F.first("x").alias("x"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), "tree", "source_id"), 256)
    samples = row_numbers(spread.withColumn("_o", order), ["tree"], [F.col("_o"), F.col("source_id")], "_r").where(
        F.col("_r") <= TREE_ROWS
    )

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source_id")
        rng = np.random.default_rng(seed + int(part["tree"].iloc[0]))
        limit = int(np.ceil(np.log2(max(len(part), 2))))
        nodes = _grow(np.stack(part["x"].to_numpy()), rng, limit)
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "size": [len(part)], "nodes": [nodes]})

    forest = samples.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes array<array<double>>").collect()
    # At most `trees` rows of at most 2 * 256 nodes.
    packed = df.sparkSession.sparkContext.broadcast(
        [(row["size"], np.array([list(n) for n in row["nodes"]])) for row in sorted(forest, key=lambda r: r["tree"])]
    )

    @F.pandas_udf("double")
    def isolation(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype="float64")
        rows = np.stack(values.to_numpy())
        total = np.zeros(len(rows))
        scale = 0.0
        for size, nodes in packed.value:
            at = np.zeros(len(rows), dtype="int64")
            active = nodes[at, 0] >= 0
            while active.any():
                ids = np.flatnonzero(active)
                here = nodes[at[ids]]
                left = rows[ids, here[:, 0].astype("int64")] < here[:, 1]
                at[ids] = np.where(left, here[:, 2], here[:, 3]).astype("int64")
                active[ids] = nodes[at[ids], 0] >= 0
            total += nodes[at, 4]
            scale += float(_average_depth(size))
        return pd.Series(np.power(2.0, -total / max(scale, 1e-12)))

    scored = settle(df.withColumn("_raw", isolation(_matrix(df, columns))))
    limits = scored.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    return with_row(scored, limits).withColumn(
        "score", (F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    ).drop("_raw", "_lo", "_hi")


def with_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Double features and a 0/1 column per feature for a missing value."""
    return df.withColumns(
        {c: F.col(c).cast("double") for c in columns}
        | {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
        | {LABEL: F.col(LABEL).cast("double")}
    )


def tabular_stages(columns: Sequence[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in columns]], outputCol="features"),
    ]


def gbt(seed: int = 17, rounds: int = 20, depth: int = 4, weight: str | None = None) -> GBTClassifier:
    model = GBTClassifier(
        labelCol=LABEL, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1,
        subsamplingRate=0.8, featureSubsetStrategy="all", minInstancesPerNode=10, maxBins=64, seed=seed,
    )
    return model.setWeightCol(weight) if weight else model


def logistic(weight: str | None = None, reg: float = 0.01, rounds: int = 20) -> LogisticRegression:
    model = LogisticRegression(labelCol=LABEL, featuresCol="features", regParam=reg, maxIter=rounds)
    return model.setWeightCol(weight) if weight else model


def probability() -> Column:
    return vector_to_array("probability")[1]


def usable_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one known value; a median needs one."""
    known = train.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if known[c]]


def fit_tabular(train: DataFrame, columns: Sequence[str], classifier) -> PipelineModel:
    forbid_leakage(columns)
    kept = usable_columns(train, columns)
    return Pipeline(stages=[*tabular_stages(kept), classifier]).fit(with_indicators(train, columns))


def apply_model(model: Transformer, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    scored = model.transform(with_indicators(test, columns)).withColumn("score", probability())
    return scored.select("source_id", "score")


BINS = 64
"""Quantile bins of a feature; a missing value has a bin of its own."""


def binned(train: DataFrame, frames: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """(rows, ``bins``) of each frame: one vector of bin numbers, in the order of ``columns``, written once.

    The bins come from the training rows alone and serve every set of features that is sliced from the vector.
    """
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    names = [f"{c}_bin" for c in columns]
    cut = QuantileDiscretizer(inputCols=list(columns), outputCols=names, numBuckets=BINS, handleInvalid="keep")
    fitted, vector = cut.fit(train.withColumns(values)), VectorAssembler(inputCols=names, outputCol="bins")
    kept = ["source_id", "country", "block_id", LABEL, "eog_flare_id"]
    ordered = {n: F.col(n) + F.lit(0.0) for n in names}  # a new column is a number, not a category

    def one(frame: DataFrame) -> DataFrame:
        placed = fitted.transform(frame.withColumns(values | {LABEL: F.col(LABEL).cast("double")})).withColumns(ordered)
        return settle(vector.transform(placed).select(*kept, "bins"))

    return [one(f) for f in frames]


def feature_ablation(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], seed: int = 17, rounds: int = 20) -> DataFrame:
    """Held-out scores of one boosted fit for each feature set, long over ``branch``."""
    known = set(usable_columns(train, sorted({c for columns in sets.values() for c in columns})))
    used = {name: [c for c in columns if c in known] for name, columns in sets.items()}
    columns = sorted({c for own in used.values() for c in own})
    forbid_leakage(columns)
    fit_rows, held = binned(train, [train, test], columns)
    place = {c: i for i, c in enumerate(columns)}

    def one(name: str) -> DataFrame:
        slicer = VectorSlicer(inputCol="bins", outputCol="features", indices=[place[c] for c in used[name]])
        model = Pipeline(stages=[slicer, gbt(seed, rounds)]).fit(fit_rows)
        return settle(model.transform(held).select("source_id", F.lit(name).alias("branch"), probability().alias("score")))

    parts = in_parallel(train.sparkSession, [lambda n=n: one(n) for n, own in used.items() if own])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return held.drop("bins").withColumn(LABEL, F.col(LABEL).cast("int")).join(whole, "source_id")


FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def gbt_score(columns: Sequence[str], seed: int = 17, rounds: int = 20, depth: int = 4, weight: str | None = None) -> FitPredict:
    """(train, test) -> (source_id, score) with boosted trees."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return apply_model(fit_tabular(train, columns, gbt(seed, rounds, depth, weight)), test, columns)

    return run


def logistic_score(columns: Sequence[str], weight: str | None = None) -> FitPredict:
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return apply_model(fit_tabular(train, columns, logistic(weight)), test, columns)

    return run


def mean_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Mean score per source over several scored frames."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("source_id").agg(F.avg("score").alias("score"))


def pu_gbt_score(columns: Sequence[str], bags: int = 3, ratio: float = 10, seed: int = 17, rounds: int = 20) -> FitPredict:
    """Mean over bags of all positives with a seeded draw of unlabelled rows."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        drawn = settle(folds.pu_bags(train, bags, ratio, seed))
        fits = [
            lambda b=b: gbt_score(columns, seed + b, rounds)(drawn.where(F.col("bag") == b).drop("bag"), test)
            for b in range(bags)
        ]
        return mean_of(in_parallel(train.sparkSession, fits))

    return run


def seed_ensemble(columns: Sequence[str], seed: int, offsets: Sequence[int] = (0, 101, 202), rounds: int = 20) -> FitPredict:
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        fits = [lambda o=o: gbt_score(columns, seed + o, rounds)(train, test) for o in offsets]
        return mean_of(in_parallel(train.sparkSession, fits))

    return run


def normalise_views(embedding: Column, width: int, views: int) -> Column:
    """L2-normalise each ``width``-wide view of an embedding."""

    def unit(view: Column) -> Column:
        norm = F.sqrt(F.aggregate(view, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(view, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))

    return F.concat(*[unit(F.slice(embedding, v * width + 1, width)) for v in range(views)])


def embedding_stages(components: int, vector: str = "views") -> list:
    """Standardise and project; fitted on training rows only."""
    return [
        StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=components, inputCol="_scaled", outputCol="pca"),
    ]


def with_views(df: DataFrame, width: int, views: int) -> DataFrame:
    return df.withColumn("views", array_to_vector(normalise_views(F.col("embedding"), width, views)))


def embedding_features(train: DataFrame, test: DataFrame, components: int = 12, width: int = 512, views: int = 2) -> DataFrame:
    model = Pipeline(stages=embedding_stages(components)).fit(with_views(train, width, views))
    return model.transform(with_views(test, width, views)).withColumn("pca", vector_to_array("pca"))


def visual_pu_score(
    aux: Sequence[str], components: int = 12, c: float = 0.1, bags: int = 5, ratio: float = 2.0, seed: int = 42,
    width: int = 512, views: int = 2,
) -> FitPredict:
    """Projected views and imputed auxiliary features into bagged, weighted logistic models."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        filled = [f"{a}_filled" for a in aux]
        stages = embedding_stages(components)
        inputs = ["pca"]
        if aux:
            stages += [
                Imputer(inputCols=list(aux), outputCols=filled, strategy="median"),
                VectorAssembler(inputCols=filled, outputCol="_aux"),
                StandardScaler(inputCol="_aux", outputCol="aux", withMean=True, withStd=True),
            ]
            inputs.append("aux")
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        weighted = folds.country_class_weights(train).withColumn(LABEL, F.col(LABEL).cast("double"))
        prepared = with_views(weighted, width, views)
        shared = Pipeline(stages=stages).fit(prepared)
        space = shared.transform(prepared).select("source_id", LABEL, "weight", "features")
        drawn = settle(folds.pu_bags(space, bags, ratio, seed, minimum=5))
        held = settle(shared.transform(with_views(test, width, views)).select("source_id", "features"))

        def one(bag: int) -> DataFrame:
            part = drawn.where(F.col("bag") == bag)
            model = logistic("weight", 1 / (c * max(part.count(), 1))).fit(part)
            return model.transform(held).select("source_id", probability().alias("score"))

        return mean_of(in_parallel(train.sparkSession, [lambda b=b: one(b) for b in range(bags)]))

    return run


def oof_predict(df: DataFrame, fold: str, fit_predict: FitPredict, values: Sequence | None = None) -> DataFrame:
    """Scores of every fold from a model of the other folds.

    The driver loops over the few folds only; each fit and each score is a
    distributed job over a frame written once.
    """
    frame = settle(df)
    names = values if values is not None else sorted(r[0] for r in frame.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(names) > MOST_FOLDS:
        raise ValueError(f"{fold} has more than {MOST_FOLDS} values: not a fold")
    steps = [
        lambda v=v: fit_predict(frame.where(F.col(fold) != v), frame.where(F.col(fold) == v)) for v in names
    ]
    parts = in_parallel(df.sparkSession, steps)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return frame.join(out, "source_id")


def freeze(model: PipelineModel, folder: str, columns: Sequence[str], threshold: float, protocol: str, holdout: str) -> None:
    """Save a fitted model beside a manifest: protocol, features in order, threshold, untouched hold-out."""
    model.write().overwrite().save(f"{folder}/model")
    spark = SparkSession.active()
    row = (protocol, list(columns), float(threshold), holdout, False)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def thaw(spark: SparkSession, folder: str, protocol: str, holdout: str) -> tuple[PipelineModel, list[str], float]:
    """Model, features and threshold of a frozen folder, refused unless its manifest fits."""
    rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the manifest is not one row")
    manifest = rows[0]
    if manifest.protocol != protocol:
        raise ValueError(f"frozen under protocol {manifest.protocol}, wanted {protocol}")
    if manifest.holdout != holdout or manifest.holdout_seen is not False:
        raise ValueError(f"{holdout} is not documented as an untouched hold-out")
    check_frozen(manifest.features or [], manifest.threshold)
    model = PipelineModel.load(f"{folder}/model")
    used = {c.removesuffix("_filled").removesuffix("_missing") for c in model.stages[-2].getInputCols()}
    if not used <= set(manifest.features):
        raise ValueError(f"the model uses features that the manifest lacks: {sorted(used - set(manifest.features))}")
    return model, list(manifest.features), manifest.threshold


def check_frozen(columns: Sequence[str], threshold: float | None) -> None:
    if not columns or len(columns) != len(set(columns)) or set(columns) & BLOCKED:
        raise ValueError("feature list is empty, duplicated or leaking")
    if threshold is None or not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")


def frozen_score(model: PipelineModel, df: DataFrame, columns: Sequence[str], threshold: float, country: str) -> DataFrame:
    """Validate, score, flag and rank one untouched country with a frozen model."""
    check_frozen(columns, threshold)
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    if not df.where(F.col("country") != country).isEmpty():
        raise ValueError("the table holds another country")
    broken = violations(df, columns).where(
        (F.col("rows") > 0) & F.col("rule").rlike("^(not finite|duplicate|null|label)")
    )
    if not broken.isEmpty():
        raise ValueError("the table breaks the input rules")
    scored = df.select("source_id", "block_id", "country", "lat", "lon", LABEL, "eog_flare_id").join(
        apply_model(model, df, columns), "source_id"
    )
    sound = is_score(F.col("score")) & F.col("score").between(0, 1)
    refused = F.raise_error(F.lit("the model gave a score outside [0, 1]")).cast("double")
    scored = scored.withColumn("score", F.when(sound, F.col("score")).otherwise(refused))
    ranked = row_numbers(scored, [], [F.col("score").desc(), F.col("source_id")], "score_rank").drop("score_rank_group")
    return ranked.withColumn("predicted", F.col("score") >= threshold)


def feature_importance(models: Sequence[PipelineModel], df: DataFrame) -> DataFrame:
    """Importance per feature averaged over models; one row per column of the schema."""
    totals: dict[str, float] = {}
    for model in models:
        names = model.stages[-2].getInputCols()
        for name, value in zip(names, model.stages[-1].featureImportances.toArray()):
            totals[name] = totals.get(name, 0.0) + float(value) / len(models)
    rows = [(n.removesuffix("_filled"), v) for n, v in totals.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def nested_loco(df: DataFrame, fit_predict: FitPredict, inner_folds: int = 3) -> DataFrame:
    """Per held-out country: threshold from grouped inner scores, refit, score once.

    The held-out country never enters folds, weights or the threshold. Returns
    the predictions with the threshold each country was judged by.
    """
    # Blocks merge inside a country only, so one pass serves every held-out country.
    frame = settle(df.join(folds.site_safe_blocks(df), ["country", "block_id"]))
    countries = sorted(r["country"] for r in folds.leave_country_out(frame).select("country").collect())

    def judge(country: str) -> DataFrame:
        train = frame.where(F.col("country") != country)
        test = frame.where(F.col("country") == country)
        grouped = folds.grouped_folds(train, inner_folds, "evaluation_block")
        inner = oof_predict(grouped, "fold", fit_predict, range(inner_folds))
        chosen = ev.macro_f1_threshold(inner.select("country", LABEL, "score"), [])
        scored = with_row(test.join(fit_predict(train, test), "source_id"), chosen)
        return settle(scored.select("source_id", "country", "block_id", LABEL, "eog_flare_id", "score", "threshold"))

    parts = in_parallel(df.sparkSession, [lambda c=c: judge(c) for c in countries])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
