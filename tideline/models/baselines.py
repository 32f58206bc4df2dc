"""Text classifiers of labelled events as Spark ML pipelines: comparison on a chronological split, walk-forward evaluation.

Rows have text_clean, the label column, and the context columns of CONTEXT; realised targets are never features.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.temporal import cut
from .prefixes import Known, label_prefixes, term_prefixes, text_prefixes

TARGET = "tradeability_label"
# What is known of a post before the market moves.
CONTEXT = ["post_length", "token_count", "all_caps_ratio", "exclamation_count", "question_mark_count", "has_image", "has_video", "rule_sentiment_confidence"]
#: fits that run side by side
FITS = 4
FEATURES = 250
#: the text's vector
VECTOR = "_tfidf"
MODELS = ["tfidf_logreg", "tfidf_linear_svm", "boosted_trees", "mlp"]


def context_features(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The context columns as doubles, nulls as 0, and further columns as they are; no other column passes."""
    return df.select(*(extra or []), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CONTEXT))


def label_index(df: DataFrame, target: str = TARGET) -> DataFrame:
    """(label, index): the classes in order, from 0; null labels are no class."""
    names = df.where(F.col(target).isNotNull()).agg(F.array_sort(F.collect_set(F.col(target).cast("string"))).alias("names"))
    return names.select(F.posexplode("names").alias("index", "label")).select("label", "index")


def gram_stages() -> list:
    """Words of two letters or more and pairs of them; nothing to fit."""
    return [
        SQLTransformer(statement="SELECT *, coalesce(text_clean, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _grams FROM __THIS__"),
    ]


def _rarities(known: Known) -> ElementwiseProduct:
    return ElementwiseProduct(scalingVec=Vectors.dense(known.idf), inputCol="_counts", outputCol="_weighted")


def _unit() -> Normalizer:
    return Normalizer(inputCol="_weighted", outputCol=VECTOR)


def text_stages(features: int = FEATURES, known: Known | None = None) -> list:
    """The most frequent words and pairs, weighted by rarity, to length 1. What is known of the training rows isn't counted again."""
    if known:
        return [*gram_stages(), CountVectorizerModel.from_vocabulary(known.terms, inputCol="_grams", outputCol="_counts"), _rarities(known), _unit()]
    return [*gram_stages(), CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=features), IDF(inputCol="_counts", outputCol="_weighted"), _unit()]


def counted(df: DataFrame, counts: CountVectorizerModel) -> DataFrame:
    """df as a table with the counts of the text's words and pairs instead of the text."""
    found = PipelineModel([*gram_stages(), counts]).transform(df)
    return cut(found.select(*(c for c in df.columns if c != "text_clean"), counts.getOutputCol()))


def vectors(df: DataFrame, features: int = FEATURES, known: Known | None = None, train: str = "true") -> tuple[DataFrame, PipelineModel]:
    """df with the text's vector instead of the text, and text_stages() fitted on the labelled rows where `train` holds.

    Fits pass over their rows many times. A text is cut into words once for the vocabulary and once for a table of
    counts, on which all else is fitted.
    """
    if known:
        text = PipelineModel(text_stages(known=known))
        rows = counted(df, text.stages[4])
    else:
        own = F.expr(train) & F.col(TARGET).isNotNull()
        counts, rarities, unit = text_stages(features)[4:]
        counts = counts.fit(PipelineModel(gram_stages()).transform(df.where(own).select("text_clean")))
        rows = counted(df, counts)
        text = PipelineModel([*gram_stages(), counts, rarities.fit(rows.where(own).select("_counts")), unit])
    return PipelineModel(text.stages[5:]).transform(rows).drop("_counts", "_weighted"), text


def fold_vectors(rows: DataFrame, terms: list[str], known: Known) -> tuple[DataFrame, PipelineModel]:
    """vectors() of rows that have `_all`, the counts of `terms`, among which are all that is known of the fold."""
    place = {term: i for i, term in enumerate(terms)}
    own = VectorSlicer(inputCol="_all", outputCol="_counts", indices=[place[term] for term in known.terms])
    found = PipelineModel([own, _rarities(known), _unit()]).transform(rows)
    return found.drop("_all", "_counts", "_weighted"), PipelineModel(text_stages(known=known))


def context_stages() -> list:
    """The text's vector and the context columns, nulls as 0."""
    numbers = ", ".join(f"coalesce(CAST({c} AS double), 0D) AS _{c}" for c in CONTEXT)
    return [SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__"), VectorAssembler(inputCols=[VECTOR, *(f"_{c}" for c in CONTEXT)], outputCol="_features")]


def pipeline(model: str, classes: int, *, features: int = FEATURES, seed: int = 42, trees: int = 50, epochs: int = 40, steps: int = 100, width: int | None = None) -> Pipeline:
    """One of MODELS over rows with the text's vector. Labels are numbered in order; `weight` is the column of class weights."""
    index = StringIndexer(inputCol=TARGET, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    given = {"labelCol": "_label", "predictionCol": "_prediction"}
    if model == "tfidf_logreg":
        last = [LogisticRegression(featuresCol=VECTOR, probabilityCol="_probability", weightCol="weight", maxIter=200, regParam=0.01, family="multinomial", **given)]
    elif model == "tfidf_linear_svm":
        svm = LinearSVC(maxIter=steps, regParam=0.01, weightCol="weight")
        last = [OneVsRest(classifier=svm, featuresCol=VECTOR, weightCol="weight", **given)]
    elif model == "boosted_trees":
        boosted = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.05, seed=seed)
        last = [*context_stages(), OneVsRest(classifier=boosted, featuresCol="_features", **given)]
    elif model == "mlp":
        layers = [(width or features) + len(CONTEXT), 16, classes]
        last = [*context_stages(), MultilayerPerceptronClassifier(featuresCol="_features", probabilityCol="_probability", layers=layers, maxIter=epochs, seed=seed, **given)]
    else:
        raise ValueError(f"unknown model {model}")
    return Pipeline(stages=[index, *last])


def weighted(train: DataFrame, known: Known | None = None) -> DataFrame:
    """Adds the balanced class weight: rows / (classes x rows of the class). One small table of classes is joined, or written into the plan where it is known."""
    if known:
        weights = F.create_map(*(F.lit(x) for label, n in known.labels.items() for x in (label, known.rows / (len(known.labels) * n))))
        return train.withColumn("weight", F.element_at(weights, F.col(TARGET)))
    counts = train.groupBy(TARGET).agg(F.count("*").alias("_n"))
    found = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    n, k = found["n"] or 0, max(1, found["k"])
    return train.join(F.broadcast(counts), TARGET).withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("_n"))).drop("_n")


def fit(train: DataFrame, model: str, known: Known | None = None, text: PipelineModel | None = None, **options) -> PipelineModel | None:
    """The fitted pipeline, from texts on; None where the training rows have fewer than two classes (use the majority then).

    known: what prefix_statistics() has of these rows. text: the fitted text stages, where train has their vectors already.
    """
    train = train.where(F.col(TARGET).isNotNull())
    classes = list(known.labels) if known else [r[0] for r in train.select(TARGET).distinct().limit(1_000).collect()]
    if len(classes) < 2 or (known and not known.terms):
        return None
    if text is None:
        train, text = vectors(train, options.get("features", FEATURES), known)
    if model == "mlp":
        # its first layer has to have the width that the vocabulary really gets
        options["width"] = len(text.stages[4].vocabulary)
    slim = train.select(TARGET, VECTOR, *(c for c in CONTEXT if c in train.columns))
    index, *rest = pipeline(model, len(classes), **options).fit(weighted(slim, known)).stages
    return PipelineModel([index, *text.stages, *rest])


def predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """df, which has texts or their vectors, with `predicted`, its probability as `confidence`, and `probabilities`, a map of class to probability.

    Margins of models without probabilities go through a logistic curve and are made to add up to 1.
    """
    labels = fitted.stages[0].labels
    # the index skips rows without a known label: predictions need none
    begin = 1 + (next(i for i, stage in enumerate(fitted.stages) if isinstance(stage, Normalizer)) if VECTOR in df.columns else 0)
    body = PipelineModel(fitted.stages[begin:])
    out = IndexToString(inputCol="_prediction", outputCol="predicted", labels=labels).transform(body.transform(df))
    if "_probability" in out.columns:
        p = vector_to_array("_probability")
    else:
        curve = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
        total = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(curve, lambda x: x / total)
    out = out.withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, labels)), p))
    out = out.withColumn("confidence", F.element_at("probabilities", F.col("predicted")))
    return out.select(*df.columns, "predicted", "confidence", "probabilities")


def majority_predictions(train: DataFrame, test: DataFrame, known: Known | None = None) -> DataFrame:
    """test with the most frequent label of train as `predicted`."""
    if known and known.labels:
        return test.withColumn("predicted", F.lit(min(known.labels, key=lambda label: (-known.labels[label], label))))
    row = metrics.majority(train.where(F.col(TARGET).isNotNull()), TARGET).first()
    if row is None:
        raise ValueError("no training labels")
    return test.withColumn("predicted", F.lit(row[0]))


def fit_all(jobs: list[tuple[DataFrame, str, Known | None, PipelineModel | None]], options: dict, *, side_by_side: int = FITS) -> list[PipelineModel | None]:
    """fit() of every (rows, model, what is known of the rows, fitted text stages), several at once: a fit is many small jobs, between which a cluster would wait."""
    with ThreadPoolExecutor(side_by_side) as pool:
        return list(pool.map(lambda job: fit(*job, **options), jobs))


def predictions(train: DataFrame, test: DataFrame, models: list[str], options: dict, fits: list[PipelineModel | None] | None = None, known: Known | None = None) -> DataFrame:
    """(model, actual, predicted, confidence) of the naive and rule baselines and of each model (fits, or fitted here) on the test rows."""
    fits = fit_all([(train, name, known, None) for name in models], options) if fits is None else fits
    slim = lambda df, name: df.select(F.lit(name).alias("model"), F.col(TARGET).alias("actual"), "predicted", *([] if "confidence" in df.columns else [F.lit(None).cast("double").alias("confidence")]), *(["confidence"] if "confidence" in df.columns else []))
    out = [slim(majority_predictions(train, test, known), "naive"), slim(test.withColumn("predicted", F.col("rule_tradeability_label")), "rules")]
    for name, fitted in zip(models, fits, strict=True):
        out.append(slim(predict(fitted, test) if fitted else majority_predictions(train, test, known), name))
    return reduce(DataFrame.unionByName, out)


def compare(df: DataFrame, *, ts: str = "received_at_utc", order: list[str] | None = None, test_share: float = 0.35, models: list[str] | None = None, save: Callable[[str, PipelineModel], None] | None = None, **options) -> DataFrame:
    """Model comparison on the chronological split: position, model, status, n, accuracy, macro_f1 of each; save gets every fitted pipeline.

    status is `trained`, or `majority` for a model that found fewer than two classes and predicts the most frequent one.
    All models are fitted on one table of the texts' vectors.
    """
    split = cut(metrics.chronological_split(df, order or [ts, "event_id"], ts, test_share))
    names, text = models if models is not None else MODELS, None
    if names and split.where("split = 'train'").where(F.col(TARGET).isNotNull()).select(TARGET).distinct().limit(2).count() == 2:
        split, text = vectors(split, options.get("features", FEATURES), train="split = 'train'")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    fits = fit_all([(train, name, None, text) for name in names], options)
    for name, fitted in zip(names, fits, strict=True):
        if save and fitted:
            save(name, fitted)
    found = cut(predictions(train, test, names, options, fits))
    untrained = [name for name, fitted in zip(names, fits, strict=True) if fitted is None]
    labels = [r["label"] for r in label_index(df).orderBy("index").limit(1_000).collect()]
    at = F.array_position(F.array(*map(F.lit, ["naive", "rules", *names])), F.col("model")).cast("int")
    return metrics.summary_metrics(found, ["model"], labels).select(at.alias("position"), "model", F.when(F.col("model").isin(untrained), "majority").otherwise("trained").alias("status"), "n", "accuracy", "macro_f1")


def prefix_counts(rows: DataFrame, ends: list[int], features: int = FEATURES) -> tuple[list[Known], DataFrame, list[str]]:
    """prefix_statistics(), and counted() rows with `_all`, the counts of all their terms, which come last; rows as they are if there are none."""
    labelled = rows.where(F.col(TARGET).isNotNull())
    texts = PipelineModel(gram_stages()).transform(labelled.select("row_index", "text_clean"))
    best = term_prefixes(texts, "_grams", ends, features) if ends else []
    terms = sorted({term for found in best for term in found})
    labels = label_prefixes(labelled, TARGET, ends) if ends else []
    if not terms:
        return [Known(own, [], []) for own in labels], rows, terms
    table = counted(rows, CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_all"))
    having = text_prefixes(table.where(F.col(TARGET).isNotNull()), "_all", terms, ends)
    return [Known(own, found, [n[term] for term in found]) for own, found, n in zip(labels, best, having, strict=True)], table, terms


def prefix_statistics(rows: DataFrame, ends: list[int], features: int = FEATURES) -> list[Known]:
    """For each end, in order, what a fit on the labelled rows with a row_index below it would count: labels, the most frequent words and pairs, and the texts that have them."""
    return prefix_counts(rows, ends, features)[0]


def walk_forward(df: DataFrame, *, ts: str = "received_at_utc", order: list[str] | None = None, max_folds: int = 50, models: tuple[str, ...] = ("tfidf_logreg", "tfidf_linear_svm"), first_train: int, test_rows: int, step: int, embargo_rows: int = 1, purge_minutes: int = 30, **options) -> DataFrame:
    """(model, fold, actual, predicted) of all folds, fitted side by side. A fold costs a fit of each model: more than max_folds are an error, choose a longer step.

    Vocabularies and class counts of all folds come from one pass over the rows, rarities and vectors from a table with
    the counts of all folds' terms (prefix_counts()).
    """
    folds, rows = metrics.walk_forward_folds(df, order or [ts, "event_id"], ts, first_train=first_train, test_rows=test_rows, step=step, embargo_rows=embargo_rows, purge_minutes=purge_minutes)
    plan = folds.orderBy("fold").limit(max_folds + 1).collect()
    if len(plan) > max_folds:
        raise ValueError(f"more than {max_folds} folds")
    known, rows, terms = prefix_counts(rows, [f["train_rows"] for f in plan], options.get("features", FEATURES))
    ready = [fold_vectors(rows, terms, k) if k.terms else (rows, None) for k in known]
    trains = [own.where(F.col("row_index") < f["train_rows"]) for (own, _), f in zip(ready, plan, strict=True)]
    fits = fit_all([(train, name, k, text) for train, k, (_, text) in zip(trains, known, ready, strict=True) for name in models], options)
    out = []
    for k, f in enumerate(plan):
        test = ready[k][0].where(F.col("row_index").between(f["test_start"], f["test_end"] - 1))
        own = fits[k * len(models) : (k + 1) * len(models)]
        out.append(predictions(trains[k], test, list(models), options, own, known[k]).withColumn("fold", F.lit(f["fold"])))
    if not out:
        return rows.select(F.lit("").alias("model"), F.col(TARGET).alias("actual"), F.lit("").alias("predicted"), F.lit(0).alias("fold")).where("false")
    return cut(reduce(DataFrame.unionByName, out).drop("confidence"))
