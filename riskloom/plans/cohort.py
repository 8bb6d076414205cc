"""The risk cohort and score tables that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "target"
FEATURES = ["age", "sex", "cp", "chol", "thalach", "oldpeak", "slope", "ca", "thal"]
CODES = ["sex", "cp", "slope"]
SPARSE = ["ca", "thal"]
PRICE_CEILING = 105_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    """Names a line item. The price in cents is part of it: the other four repeat now and then."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents.cast("string"))


KEY_SQL = (
    "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))"
)


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a record; gaps in three columns, and copies of the smallest orders' records."""
    copies = F.when(F.col("l_quantity") == 1, 2).otherwise(1)
    lines = table(spark, sf_dir, "lineitem").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    number = lambda c: c.cast("double")
    return lines.select(
        line_key().alias("row_key"),
        F.col("l_quantity").alias("age"),
        number((F.col("l_linestatus") == "F").cast("int")).alias("sex"),
        number(F.col("l_linenumber") % 4).alias("cp"),
        F.col("l_extendedprice").alias("chol"),
        number(F.dayofyear("l_shipdate")).alias("thalach"),
        F.col("l_discount").alias("oldpeak"),
        F.when(F.col("l_discount") > 0, number(F.col("l_linenumber") % 3)).alias("slope"),
        F.when((F.col("l_tax") > 0) & (F.col("l_tax") < 0.075), number(F.col("l_linenumber"))).alias("ca"),
        F.when(F.col("l_tax") > 0.025, F.lit(1.0)).alias("thal"),
        (
            (F.col("l_returnflag") == "R").cast("int") + 2 * (F.col("l_extendedprice") > 70000).cast("int")
        ).alias(LABEL),
    )


COHORT_SQL = f"""cohort AS (
  SELECT {KEY_SQL} AS row_key,
         l_quantity AS age,
         CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS sex,
         CAST(l_linenumber % 4 AS DOUBLE) AS cp,
         l_extendedprice AS chol,
         CAST(dayofyear(l_shipdate) AS DOUBLE) AS thalach,
         l_discount AS oldpeak,
         CASE WHEN l_discount > 0 THEN CAST(l_linenumber % 3 AS DOUBLE) END AS slope,
         CASE WHEN l_tax > 0 AND l_tax < 0.075 THEN CAST(l_linenumber AS DOUBLE) END AS ca,
         CASE WHEN l_tax > 0.025 THEN CAST(1 AS DOUBLE) END AS thal,
         CAST((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
            + (CASE WHEN l_extendedprice > 70000 THEN 2 ELSE 0 END) AS INTEGER) AS target
  FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity = 1)
)"""

CLEAN_SQL = f"""{COHORT_SQL},
deduped AS (SELECT DISTINCT * FROM cohort),
cleaned AS (
  SELECT row_key, age, sex, cp, chol, thalach, oldpeak,
         coalesce(slope, (SELECT slope FROM deduped WHERE slope IS NOT NULL
                          GROUP BY slope ORDER BY count(*) DESC, slope LIMIT 1)) AS slope,
         coalesce(ca, (SELECT quantile_cont(ca, CAST(0.5 AS DOUBLE)) FROM deduped)) AS ca,
         CASE WHEN target > 0 THEN 1 ELSE 0 END AS target
  FROM deduped
)"""

SPLIT_SQL = f"""{CLEAN_SQL},
classes AS (SELECT target, count(*) AS n FROM cleaned GROUP BY target),
totals AS (SELECT sum(n) AS total, sum(n) - ceil(0.2 * sum(n)) AS n_train FROM classes),
shares AS (
  SELECT target, n, n_train, CAST(n AS DOUBLE) * n_train / total AS share FROM classes, totals
),
cuts AS (
  SELECT target,
         n - (floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, target)
                                       <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END) AS n_test
  FROM shares
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws('|', '42', row_key))) AS place FROM cleaned
),
marked AS (
  SELECT r.* EXCLUDE (place), CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN cuts USING (target)
)"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_key, label, score, prediction): three simple scores of every line item."""
    lines = table(spark, sf_dir, "lineitem")
    score = lambda name, c: F.struct(F.lit(name).alias("model"), c.alias("score"))
    return lines.select(
        line_key().alias("row_key"),
        ((F.col("l_returnflag") == "R") | (F.col("l_extendedprice") > 70000)).cast("int").alias("label"),
        F.inline(
            F.array(
                score("price", F.col("l_extendedprice") / PRICE_CEILING),
                score("quantity", F.col("l_quantity") / 50),
                score("discount", F.col("l_discount")),
            )
        ),
    ).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


SCORES_SQL = f"""scores AS (
  SELECT {KEY_SQL} AS row_key, m.model,
         CASE WHEN l_returnflag = 'R' OR l_extendedprice > 70000 THEN 1 ELSE 0 END AS label,
         m.score, CASE WHEN m.score > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (
    SELECT *, unnest([{{'model': 'price', 'score': l_extendedprice / CAST(105000 AS DOUBLE)}},
                      {{'model': 'quantity', 'score': l_quantity / CAST(50 AS DOUBLE)}},
                      {{'model': 'discount', 'score': l_discount}}]) AS m
    FROM lineitem
  )
)"""

MODEL_ORDER = ["price", "quantity", "discount"]

METRICS_SQL = f"""{SCORES_SQL},
cells AS (
  SELECT model,
         CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (label = 0 AND prediction = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (label = 1 AND prediction = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (label = 0 AND prediction = 0) AS DOUBLE) AS tn
  FROM scores GROUP BY model
),
at_score AS (
  SELECT model, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
  FROM scores GROUP BY model, score
),
runs AS (
  SELECT *, sum(pos) OVER w AS run_pos, sum(neg) OVER w AS run_neg,
         sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg,
         row_number() OVER w AS place,
         lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM at_score WINDOW w AS (PARTITION BY model ORDER BY score DESC)
),
areas AS (
  SELECT model, sum(neg * (run_pos - pos / 2)) / max(all_pos * all_neg) AS auc FROM runs GROUP BY model
),
metrics AS (
  SELECT model,
         round_even((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
         round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS "precision",
         round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
         round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
         round_even(auc, 4) AS roc_auc
  FROM cells JOIN areas USING (model)
)"""


def customer_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with a probability made from the account balance."""
    return (
        table(spark, sf_dir, "customer")
        .withColumn("probability", (F.col("c_acctbal") + 1000) / 11000)
        .withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    )


CUSTOMER_SQL = """risk_base AS (
  SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT *, (c_acctbal + 1000) / 11000 AS probability FROM customer)
)"""
