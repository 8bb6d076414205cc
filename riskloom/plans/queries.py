"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions.session import checkpoint_dir, cut_lineage
from riskloom.operators import clean as cl
from riskloom.operators import codes, evaluate, explain, profile
from riskloom.operators.knn import NeighbourIndex, knn_score, share_of_positive, vector_of
from riskloom.operators.models import (
    REGISTRY,
    Fitted,
    LinearScore,
    ModelSpec,
    Trained,
    feature_importance as importances,
    spec_of,
    train_all,
)
from riskloom.operators.report import report_rows as report_of
from riskloom.operators.scale import apply_scaler, fit_scaler
from riskloom.operators.score import confidence as confidence_of
from riskloom.operators.score import gauge, risk_band as bands, score
from riskloom.operators.split import stratified_split as split_of
from riskloom.operators.trees import Tree
from riskloom.plans.cohort import (
    CODES,
    FEATURES,
    LABEL,
    MODEL_ORDER,
    SPARSE,
    customer_risk,
    line_key,
    model_scores,
    raw_cohort,
    table,
)
from riskloom.sources.artifacts import load_notes, load_results, save_results
from riskloom.sources.tables import as_numbers, read_checked_table
from riskloom.streaming.score import score_stream as stream_of
from riskloom.streaming.score import write_batches, write_scores

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

NUMBERS = ["age", "chol", "oldpeak", "slope", "ca"]
LINE_WEIGHTS = {"l_quantity": 0.0317, "l_extendedprice": 0.00002, "l_discount": -4.0, "l_tax": 6.0}
LINE_INTERCEPT = -1.5
AS_OF = "2024-03-05 14:07:09"


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def binary_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.binarise(raw_cohort(spark, sf_dir), LABEL)


def cleaned(spark: SparkSession, sf_dir: str) -> cl.Cleaned:
    return cl.clean(raw_cohort(spark, sf_dir), LABEL, FEATURES, CODES, SPARSE, carry=["row_key"])


def marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    done = cleaned(spark, sf_dir)
    return split_of(done.df, LABEL, ["row_key"]), done.features


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows, features = marked(spark, sf_dir)
    pick = lambda s: rows.where(F.col("split") == s).drop("split")
    return pick("train"), pick("test"), features


def trained(spark: SparkSession, sf_dir: str, models: Sequence[ModelSpec]) -> tuple[Trained, DataFrame]:
    train, test, features = parts(spark, sf_dir)
    return train_all(train, test, features, LABEL, "row_key", models), test


# Profiles


@query
def count_by_labels(spark, sf_dir):
    """Cases and non-cases per labelled code."""
    labels = {"cp": config.CODE_LABELS["cp"], LABEL: config.CODE_LABELS["target"]}
    return codes.count_by(binary_cohort(spark, sf_dir), ["cp", LABEL], labels)


@query
def count_by_codes(spark, sf_dir):
    labels = {"sex": config.CODE_LABELS["sex"], LABEL: config.CODE_LABELS["target"]}
    return codes.count_by(binary_cohort(spark, sf_dir), ["sex", LABEL], labels)


@query
def count_by_unmapped(spark, sf_dir):
    """Severity has a code without a label; its rows are kept under NULL."""
    labels = {LABEL: config.CODE_LABELS["target"]}
    return codes.count_by(raw_cohort(spark, sf_dir), ["slope", LABEL], labels, keep_unmapped=True)


@query
def preview_rows(spark, sf_dir):
    """The first 20 rows in key order."""
    shown = codes.rename_display(binary_cohort(spark, sf_dir), config.DISPLAY_NAMES)
    return profile.preview(shown, 20, ["row_key"])


@query
def dataset_card(spark, sf_dir):
    return profile.dataset_card(binary_cohort(spark, sf_dir), LABEL)


@query
def quality_summary(spark, sf_dir):
    return profile.quality_report(raw_cohort(spark, sf_dir), LABEL).summary


@query
def quality_columns(spark, sf_dir):
    return profile.quality_report(raw_cohort(spark, sf_dir), LABEL).columns


@query
def class_distribution(spark, sf_dir):
    return profile.quality_report(raw_cohort(spark, sf_dir), LABEL).classes


@query
def describe(spark, sf_dir):
    return profile.describe(binary_cohort(spark, sf_dir))


@query
def missing_summary(spark, sf_dir):
    return profile.missing_summary(raw_cohort(spark, sf_dir), config.DISPLAY_NAMES, only_missing=True)


@query
def feature_dictionary(spark, sf_dir):
    """The dictionary beside the number of gaps counted in each column."""
    rows = raw_cohort(spark, sf_dir)
    names = codes.feature_dictionary(rows, config.DISPLAY_NAMES, config.DESCRIPTIONS)
    gaps = profile.quality_columns(rows).select(F.col("feature").alias("column"), "missing_count")
    return names.join(F.broadcast(gaps), "column", "left")


@query
def rename_display(spark, sf_dir):
    rows = binary_cohort(spark, sf_dir).select("row_key", "age", "sex", LABEL)
    return codes.rename_display(rows, config.DISPLAY_NAMES)


@query
def histogram(spark, sf_dir):
    return rounded(profile.histogram(binary_cohort(spark, sf_dir), "chol", LABEL, 25))


@query
def histogram_all(spark, sf_dir):
    return rounded(profile.histogram_all(binary_cohort(spark, sf_dir), NUMBERS, LABEL, 20))


@query
def histogram_nice(spark, sf_dir):
    return rounded(profile.histogram(binary_cohort(spark, sf_dir), "chol", LABEL, 25, edges="nice"))


@query
def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(binary_cohort(spark, sf_dir), NUMBERS, LABEL))


@query
def outliers(spark, sf_dir):
    """Events whose value lies outside the fences of their type."""
    return profile.outliers(table(spark, sf_dir, "events"), ["event_id"], ["value"], "event_type")


@query
def density(spark, sf_dir):
    return rounded(profile.density(binary_cohort(spark, sf_dir), "age", LABEL))


@query
def density_continuous(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(profile.density(events, "value", "event_type", 32))


@query
def correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(binary_cohort(spark, sf_dir))


@query
def target_correlation(spark, sf_dir):
    return rounded(profile.target_correlation(binary_cohort(spark, sf_dir), LABEL))


# Cleaning


@query
def binarise(spark, sf_dir):
    return binary_cohort(spark, sf_dir).select("row_key", LABEL)


@query
def binarise_guarded(spark, sf_dir):
    """A label of two values stays as it is; one of four becomes 0 or 1."""
    labels = table(spark, sf_dir, "labels")
    kept = cl.binarise(labels.withColumn("grade", F.col("quality") + 1), "grade", only_if_multiclass=True)
    cut = cl.binarise(
        kept.withColumn("level", F.col("quality") + 2 * F.col("toxic") - 1), "level", only_if_multiclass=True
    )
    return cut.select("doc_id", "grade", "level")


@query
def deduplicate(spark, sf_dir):
    return cl.deduplicate(raw_cohort(spark, sf_dir))


@query
def deduplicate_texts(spark, sf_dir):
    """Documents that are copies in language and whole text."""
    return cl.deduplicate(table(spark, sf_dir, "documents").select("lang", "text"), by_digest=True)


@query
def missing_fraction(spark, sf_dir):
    return rounded(cl.missing_fraction(cl.deduplicate(raw_cohort(spark, sf_dir)), ["slope", *SPARSE]))


@query
def impute_mode(spark, sf_dir):
    rows = raw_cohort(spark, sf_dir).select("row_key", "slope")
    return cl.impute(rows, {"slope": "mode"})


@query
def impute_median(spark, sf_dir):
    rows = raw_cohort(spark, sf_dir).select("row_key", "ca")
    return cl.impute(rows, {"ca": "median"})


@query
def coerce_numeric(spark, sf_dir):
    """Numbers in text: plain, padded, with exponent, with a trailing letter, and words."""
    text = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.substring_index("c_name", "#", -1).alias("plain"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("padded"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("e2")).alias("exponent"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("d")).alias("lettered"),
        F.col("c_mktsegment").alias("word"),
    )
    return cl.coerce_numeric(text, ["plain", "padded", "exponent", "lettered", "word"])


@query
def clean_cohort(spark, sf_dir):
    return cleaned(spark, sf_dir).df


@query
def melt(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return codes.melt(rows, ["p_partkey"], ["p_size", "p_retailprice"], {"p_size": "Size"})


@query
def map_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    words = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    return codes.map_codes(rows, "o_orderpriority", words, "priority")


@query
def record_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return codes.record_to_rows(rows, "p_partkey", ["p_size", "p_retailprice"], {"p_retailprice": "Retail Price"})


@query
def validate_domain(spark, sf_dir):
    rows = raw_cohort(spark, sf_dir).select("row_key", "age", "cp", "thalach", "slope")
    # Copies of a record fail alike; one report per record is enough.
    return cl.validate_domain(cl.deduplicate(rows), "row_key", config.DOMAINS)


# Split and scaling


@query
def stratified_split(spark, sf_dir):
    rows, _ = marked(spark, sf_dir)
    return rows.select("row_key", LABEL, "split")


@query
def scaler_params(spark, sf_dir):
    train, _, features = parts(spark, sf_dir)
    return rounded(fit_scaler(train, features))


@query
def scaled(spark, sf_dir):
    train, test, features = parts(spark, sf_dir)
    done = apply_scaler(test, fit_scaler(train, features))
    return rounded(done.select("row_key", LABEL, *features), 5)


# Evaluation


def score_metrics(spark, sf_dir):
    return evaluate.classification_metrics(model_scores(spark, sf_dir), "label", "prediction", "score", ["model"])


@query
def classification_metrics(spark, sf_dir):
    return score_metrics(spark, sf_dir)


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(model_scores(spark, sf_dir), "label", "prediction", ["model"])


@query
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(model_scores(spark, sf_dir), "label", "score", ["model"]))


@query
def roc_auc_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("label", (F.col("event_type") == "error").cast("int"))
    return rounded(evaluate.roc_auc(rows, "label", "value"))


@query
def roc_auc_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(evaluate.roc_auc(rows, "quality", "n_chars"))


@query
def roc_curve(spark, sf_dir):
    curve = evaluate.roc_curve(model_scores(spark, sf_dir), "label", "score", ["model"])
    return rounded(curve.withColumn("threshold", F.when(F.col("threshold") < 1e300, F.col("threshold"))), 9)


@query
def metrics_long(spark, sf_dir):
    return evaluate.metrics_long(score_metrics(spark, sf_dir), names=config.METRIC_NAMES)


@query
def leaderboard(spark, sf_dir):
    return evaluate.leaderboard(score_metrics(spark, sf_dir), MODEL_ORDER)


@query
def best_model(spark, sf_dir):
    return evaluate.best_model(score_metrics(spark, sf_dir), MODEL_ORDER)


@query
def results_round_trip(spark, sf_dir):
    """Metrics, unrounded AUC and number of curve points per model, as saved and loaded again."""
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    scored = model_scores(spark, sf_dir)
    area = evaluate.roc_auc(scored, "label", "score", ["model"]).withColumnRenamed("roc_auc", "auc")
    notes = area.select("model", F.lit("linear").alias("explains"), "auc")
    save_results(score_metrics(spark, sf_dir), evaluate.roc_curve(scored, "label", "score", ["model"]), path, notes)
    metrics, curve = load_results(spark, path)
    ends = curve.groupBy("model").agg(F.max("tpr").alias("last_tpr"), F.max("fpr").alias("last_fpr"))
    return rounded(evaluate.with_curve(metrics, curve).join(load_notes(spark, path), "model").join(ends, "model"))


# Tables


@query
def ragged_round_trip(spark, sf_dir):
    """Customers written as text lines, some short, some with surplus fields, some with a missing token, and read back."""
    path = f"{checkpoint_dir(spark)}/ragged-{uuid.uuid4().hex}"
    key = F.col("c_custkey") % 10
    balance = F.when(key == 2, F.lit("?")).otherwise(F.col("c_acctbal").cast("string"))
    line = F.when(key == 0, F.concat_ws(",", "c_custkey", "c_nationkey")).when(
        key == 1, F.concat_ws(",", "c_custkey", "c_nationkey", balance, F.lit('"a, b"'), F.lit("c"))
    ).otherwise(F.concat_ws(",", "c_custkey", "c_nationkey", balance))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    read = read_checked_table(spark, path, ["c_custkey", "c_nationkey", "c_acctbal"])
    kept = as_numbers(read.rows).select(
        F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long"), F.round("c_acctbal", 2).alias("c_acctbal"),
        F.lit("row").alias("outcome"), F.lit(None).cast("long").alias("fields"),
    )
    none = F.lit(None)
    lost = read.rejected.select(
        F.split("line", ",")[0].cast("long").alias("c_custkey"), none.cast("long").alias("c_nationkey"), none.cast("double").alias("c_acctbal"),
        F.col("reason").alias("outcome"), F.col("fields").cast("long").alias("fields"),
    )
    return kept.unionByName(lost)


# Models


def held_out(kind: str) -> Query:
    def run(spark, sf_dir):
        done, _ = trained(spark, sf_dir, [spec_of(kind)])
        return done.predictions

    return run


for _name, _kind in (
    ("train_logistic", "logistic"), ("train_tree", "tree"), ("train_forest", "forest"),
    ("train_gbt", "gbt"), ("train_rbf", "rbf_svc"), ("train_knn", "knn"),
):
    _QUERIES[_name] = held_out(_kind)


@query
def train_compare(spark, sf_dir):
    """Leaderboard of every model of the registry."""
    done, _ = trained(spark, sf_dir, REGISTRY)
    return evaluate.leaderboard(done.metrics(LABEL), done.order)


@query
def feature_importance(spark, sf_dir):
    done, _ = trained(spark, sf_dir, [spec_of("tree")])
    return importances(done.fitted["Decision Tree"])


@query
def nearest_scores(spark, sf_dir):
    """Share of label 0 among the 7 nearest training vectors of each held-out vector."""
    rows = table(spark, sf_dir, "embeddings").withColumn("is_zero", (F.col("label") == 0).cast("int"))
    rows = split_of(rows, "is_zero", ["vec_id"])
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    return rounded(knn_score(train, test, "embedding", "is_zero", "vec_id", "vec_id"))


@query
def score_stream_neighbours(spark, sf_dir):
    """The neighbour scores of a file stream: a stored partition tree, searched by each batch, read back from its sink."""
    rows = table(spark, sf_dir, "embeddings").withColumn("is_zero", (F.col("label") == 0).cast("int"))
    marks = split_of(rows, "is_zero", ["vec_id"])
    base = f"{checkpoint_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    x = vector_of("embedding")
    NeighbourIndex.build(marks.where("split = 'train'"), x, "is_zero", "vec_id", 7).save(f"{base}/index")
    index = NeighbourIndex.load(spark, f"{base}/index")
    held = cut_lineage(marks.where("split = 'test'").select("vec_id"))
    stream = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parque[t]")

    def found(batch):
        return share_of_positive(index.search(batch.join(held, "vec_id", "left_semi"), x, "vec_id", 7), "vec_id")

    write_batches(stream, found, f"{base}/rows", f"{base}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/rows").drop("batch_id"))


# Scoring, attribution, reports


@query
def risk_band(spark, sf_dir):
    rows = bands(customer_risk(spark, sf_dir), "probability")
    return rounded(rows.select("c_custkey", "probability", "risk", "message"))


@query
def gauge_band(spark, sf_dir):
    rows = gauge(customer_risk(spark, sf_dir), "probability")
    return rounded(rows.select("c_custkey", "gauge_value", "gauge_delta", "gauge_band"))


@query
def confidence(spark, sf_dir):
    rows = confidence_of(customer_risk(spark, sf_dir), "probability")
    return rounded(rows.select("c_custkey", "prediction", "confidence", "diagnosis"))


def _line_scores(spark, sf_dir) -> tuple[DataFrame, Fitted]:
    """Line items with a fixed logistic score on columns scaled over the whole table."""
    rows = table(spark, sf_dir, "lineitem").select(
        line_key().alias("row_key"), *LINE_WEIGHTS
    )
    features = [*LINE_WEIGHTS, "ca"]
    scaler = fit_scaler(rows.withColumn("ca", F.lit(0.0)), features)
    model = LinearScore(features, [0.8, -0.4, 1.2, 0.5, 2.0], -0.3)
    return rows, Fitted(spec_of("logistic"), model, scaler, features)


SCORED = ["row_key", "probability", "prediction", "confidence", "diagnosis", "risk", "n_defaulted"]


@query
def score_records(spark, sf_dir):
    rows, fitted = _line_scores(spark, sf_dir)
    return rounded(score(rows, fitted).select(*SCORED))


@query
def score_stream(spark, sf_dir):
    """The same scores from a file stream, read back from its sink."""
    rows, fitted = _line_scores(spark, sf_dir)
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    records = stream.select(
        line_key().alias("row_key"), *LINE_WEIGHTS
    )
    base = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    write_scores(stream_of(records, fitted).select(*SCORED), f"{base}/rows", f"{base}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/rows"))


@query
def report_rows(spark, sf_dir):
    rows = confidence_of(bands(customer_risk(spark, sf_dir), "probability"), "probability")
    metrics = score_metrics(spark, sf_dir).where(F.col("model") == "price")
    return report_of(
        rows, "c_custkey", ["c_acctbal", "c_nationkey"], "price", {"c_acctbal": "Balance"}, metrics, AS_OF
    )


def _line_attribution(spark, sf_dir, top: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    means = rows.agg(*[F.avg(c).alias(c) for c in LINE_WEIGHTS]).first()
    named = rows.withColumn("row_key", line_key())
    features = list(LINE_WEIGHTS)
    return explain.explain_linear(
        named, "row_key", features, list(LINE_WEIGHTS.values()), [means[c] for c in features], LINE_INTERCEPT, top
    )


@query
def explain_linear(spark, sf_dir):
    return rounded(_line_attribution(spark, sf_dir))


@query
def top_contributions(spark, sf_dir):
    """The two largest of four contributions, ranked inside each record."""
    top = _line_attribution(spark, sf_dir, 2)
    return rounded(top.select("row_key", "feature", "phi", "rank", "direction"))


@query
def top_contributions_stored(spark, sf_dir):
    """The same from the long attribution table."""
    top = explain.top_contributions(_line_attribution(spark, sf_dir), "row_key", 2)
    return rounded(top.select("row_key", "feature", "phi", "rank", "direction"))


@query
def global_importance(spark, sf_dir):
    return rounded(explain.global_importance(_line_attribution(spark, sf_dir)))


@query
def explain_tree(spark, sf_dir):
    done, test = trained(spark, sf_dir, [spec_of("tree")])
    fitted = done.fitted["Decision Tree"]
    return explain.explain(apply_scaler(test, fitted.scaler), "row_key", fitted)


# Two small trees as (feature, threshold, left, right, value, cover) rows: one on quantity and discount, and one that
# asks for the tax twice.
LINE_TREES = [
    [(0, 24.5, 1, 2, 0.0, 100), (-1, 0, -1, -1, 0.2, 60), (1, 0.05, 3, 4, 0.0, 40), (-1, 0, -1, -1, 0.5, 10), (-1, 0, -1, -1, 0.9, 30)],
    [(2, 0.05, 1, 2, 0.0, 80), (2, 0.025, 3, 4, 0.0, 40), (-1, 0, -1, -1, 1.0, 40), (-1, 0, -1, -1, -1.0, 16), (-1, 0, -1, -1, 0.5, 24)],
]


@query
def explain_tree_fixed(spark, sf_dir):
    """Attribution of every line item by fixed trees, whose values SQL can work out over all coalitions."""
    rows = table(spark, sf_dir, "lineitem").withColumn("row_key", line_key())
    trees = [Tree.of(nodes) for nodes in LINE_TREES]
    found = explain.attribute_trees(rows, "row_key", ["l_quantity", "l_discount", "l_tax"], trees, "log_odds")
    return rounded(found.select("row_key", "feature", "phi", "base_value"))


@query
def explain_forest(spark, sf_dir):
    """Attribution of all held-out rows by the registry's forest of 200 trees."""
    done, test = trained(spark, sf_dir, [spec_of("forest")])
    fitted = done.fitted["Random Forest"]
    return explain.explain(apply_scaler(test, fitted.scaler), "row_key", fitted)


@query
def explain_sampled(spark, sf_dir):
    done, test = trained(spark, sf_dir, [spec_of("rbf_svc")])
    fitted = done.fitted["Support Vector Machine"]
    return explain.explain(apply_scaler(test, fitted.scaler), "row_key", fitted)


@query
def explain_sampled_linear(spark, sf_dir):
    """Attribution of a linear score of every line item over all coalitions; the background is the mean line of each return flag."""
    rows = table(spark, sf_dir, "lineitem").select(line_key().alias("row_key"), *LINE_WEIGHTS)
    background = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        *[F.avg(c).alias(c) for c in LINE_WEIGHTS], F.count("*").cast("double").alias("weight")
    )
    z = F.lit(LINE_INTERCEPT)
    for c, w in LINE_WEIGHTS.items():
        z = z + F.col(c) * F.lit(w)
    found = explain.explain_coalitions(rows, "row_key", list(LINE_WEIGHTS), lambda t: t.withColumn("probability", z), background)
    return rounded(found.select("row_key", "feature", "phi", "base_value"))


@query
def explain_boosted(spark, sf_dir):
    done, test = trained(spark, sf_dir, [spec_of("gbt")])
    fitted = done.fitted["Gradient Boosting"]
    return explain.explain(apply_scaler(test, fitted.scaler), "row_key", fitted)


@query
def background_summary(spark, sf_dir):
    train, _, features = parts(spark, sf_dir)
    return explain.background_summary(apply_scaler(train, fit_scaler(train, features)), features)
