"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from riskloom import config
from riskloom.plans.cohort import CLEAN_SQL, COHORT_SQL, CUSTOMER_SQL, FEATURES, KEY_SQL, METRICS_SQL, SCORES_SQL, SPLIT_SQL

BINARY = f"""{COHORT_SQL},
binary_cohort AS (SELECT * REPLACE (CASE WHEN target > 0 THEN 1 ELSE 0 END AS target) FROM cohort)"""
COLUMNS = ["row_key", *FEATURES, "target"]
NUMERIC = [*FEATURES, "target"]
KEPT = [c for c in FEATURES if c != "thal"]
NUMBERS = ["age", "chol", "oldpeak", "slope", "ca"]


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def labels(col: str, mapping: dict, name: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in mapping.items())
    return f"CASE {col} {cases} END AS {name}"


def long_of(table: str, cols: list[str], ids: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL" for c in cols
    )


def _rows(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def histogram_sql(cols: list[str], bins: int) -> str:
    return f"""WITH {BINARY}, long AS ({long_of("binary_cohort", cols, "target")}),
ends AS (SELECT feature, min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM long GROUP BY feature),
counts AS (
  SELECT feature, target, least(CAST(floor((v - lo) / w) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
  FROM long JOIN ends USING (feature) GROUP BY ALL
),
grid AS (
  SELECT feature, target, CAST(b AS INTEGER) AS bin
  FROM (SELECT DISTINCT feature FROM long), (SELECT DISTINCT target FROM binary_cohort WHERE target IS NOT NULL), range({bins}) AS t(b)
)
SELECT feature, target, bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi,
       coalesce(n, 0) AS count
FROM grid JOIN ends USING (feature) LEFT JOIN counts USING (feature, target, bin)"""


def density_sql(source: str, col: str, by: str, points: int) -> str:
    return f"""WITH {source} v0 AS (SELECT {by} AS k, CAST({col} AS DOUBLE) AS v FROM src WHERE {col} IS NOT NULL),
bands AS (
  SELECT k, count(*) AS n,
         1.059 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(CAST(n AS DOUBLE), -0.2) AS h
  FROM (SELECT k, count(*) AS n, stddev_samp(v) AS sd,
               (quantile_cont(v, CAST(0.75 AS DOUBLE)) - quantile_cont(v, CAST(0.25 AS DOUBLE))) / 1.349 AS iqr
        FROM v0 GROUP BY k) GROUP BY ALL
),
ends AS (SELECT min(v) AS lo, max(v) AS hi FROM v0),
grid AS (SELECT lo + i * ((hi - lo) / {points - 1}) AS x FROM ends, range({points}) AS t(i)),
merged AS (SELECT k, v, count(*) AS w FROM v0 GROUP BY k, v)
SELECT m.k AS {by}, round(x, 6) AS x,
       round(sum(w * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(b.n2) * any_value(h) * sqrt(2 * pi())), 6)
         AS density
FROM merged m JOIN (SELECT k, h, (SELECT count(*) FROM v0 WHERE v0.k = bands.k) AS n2 FROM bands) b USING (k), grid
GROUP BY m.k, x"""


def _quality() -> dict[str, str]:
    gaps = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in COLUMNS)
    types = {"row_key": "string", "target": "int"}
    per_column = lambda source, kind: _rows(
        [
            f"SELECT {text(config.DISPLAY_NAMES.get(c, c) if kind == 'shown' else c)} AS feature, "
            f"count(*) FILTER ({c} IS NULL) AS missing_count, "
            f"round_even(100 * (CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*)), 2) AS missing_pct"
            + (f", '{types.get(c, 'double')}' AS dtype" if kind == "typed" else "")
            + f" FROM {source}"
            for c in COLUMNS
        ]
    )
    described = lambda c: (
        f"SELECT '{c}' AS feature, count({c}) AS count, round_even(avg({c}), 3) AS mean, "
        f"round_even(stddev_samp({c}), 3) AS std, CAST(round_even(min({c}), 3) AS DOUBLE) AS min, "
        + ", ".join(
            f"round_even(quantile_cont(CAST({c} AS DOUBLE), CAST({p} AS DOUBLE)), 3) AS p{int(p * 100)}"
            for p in (0.25, 0.5, 0.75)
        )
        + f", CAST(round_even(max({c}), 3) AS DOUBLE) AS max FROM binary_cohort"
    )
    words = ", ".join(
        f"({text(c)}, {text(config.DISPLAY_NAMES[c])}, {text(config.DESCRIPTIONS[c])})" for c in FEATURES
    )
    counts = _rows([f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) AS n FROM cohort" for c in FEATURES])
    shown = ", ".join(f'{c} AS "{config.DISPLAY_NAMES[c]}"' for c in NUMERIC)
    return {
        "count_by_labels": f"""WITH {BINARY}
SELECT {labels("cp", config.CODE_LABELS["cp"], "cp")}, {labels("target", config.CODE_LABELS["target"], "target")},
       count(*) AS count FROM binary_cohort WHERE cp IN (0, 1, 2, 3) GROUP BY ALL""",
        "count_by_codes": f"""WITH {BINARY}
SELECT {labels("sex", config.CODE_LABELS["sex"], "sex")}, {labels("target", config.CODE_LABELS["target"], "target")},
       count(*) AS count FROM binary_cohort GROUP BY ALL""",
        "count_by_unmapped": f"""WITH {COHORT_SQL}
SELECT slope, {labels("target", config.CODE_LABELS["target"], "target")}, count(*) AS count
FROM cohort GROUP BY ALL""",
        "preview_rows": f"WITH {BINARY} SELECT row_key, {shown} FROM binary_cohort ORDER BY row_key LIMIT 20",
        "dataset_card": f"""WITH {BINARY}, c AS (
  SELECT count(*) AS n_rows, CAST(trunc(avg(CAST(target AS DOUBLE)) * 100) AS INTEGER) AS p FROM binary_cohort)
SELECT n_rows, {len(COLUMNS) - 1} AS n_features, p AS positive_pct, 100 - p AS negative_pct FROM c""",
        "quality_summary": f"""WITH {COHORT_SQL}
SELECT count(*) AS total_rows, CAST({len(COLUMNS)} AS BIGINT) AS total_cols,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cohort)) AS duplicates,
       {gaps} AS missing_total FROM cohort""",
        "quality_columns": f"WITH {COHORT_SQL} {per_column('cohort', 'typed')}",
        "missing_summary": f"WITH {COHORT_SQL} SELECT * FROM ({per_column('cohort', 'shown')}) WHERE missing_count > 0",
        "class_distribution": f"WITH {COHORT_SQL} SELECT target, count(*) AS count FROM cohort GROUP BY target",
        "describe": f"WITH {BINARY} {_rows([described(c) for c in NUMERIC])}",
        "feature_dictionary": f"""WITH {COHORT_SQL}, gaps AS ({counts})
SELECT d.c AS "column", feature, description, n AS missing_count
FROM (VALUES {words}) AS d(c, feature, description) LEFT JOIN gaps ON gaps.c = d.c""",
        "rename_display": f"""WITH {BINARY}
SELECT row_key, age AS "Age", sex AS "Sex", target AS "Heart Disease" FROM binary_cohort""",
    }


def _shapes() -> dict[str, str]:
    long = long_of("binary_cohort", NUMBERS, "target")
    nice = 5000
    r = lambda a, b: f"corr({a}, {b})"
    pairs = [(a, b) for a in NUMERIC for b in NUMERIC]
    safe = lambda a, b: f"CASE WHEN isnan({r(a, b)}) THEN NULL ELSE {r(a, b)} END"
    return {
        "histogram": histogram_sql(["chol"], 25),
        "histogram_all": histogram_sql(NUMBERS, 20),
        "histogram_nice": f"""WITH {BINARY},
counts AS (SELECT target, CAST(floor(chol / {nice}) AS INTEGER) AS bin, count(*) AS n FROM binary_cohort GROUP BY ALL),
top AS (SELECT max(chol) AS hi FROM binary_cohort),
grid AS (
  SELECT target, CAST(b AS INTEGER) AS bin
  FROM (SELECT DISTINCT target FROM binary_cohort), range(25) AS t(b), top WHERE b * {nice} < hi
)
SELECT 'chol' AS feature, target, bin, CAST(bin * {nice} AS DOUBLE) AS lo, CAST((bin + 1) * {nice} AS DOUBLE) AS hi,
       coalesce(n, 0) AS count FROM grid LEFT JOIN counts USING (target, bin)""",
        "box_stats": f"""WITH {BINARY}, long AS ({long}),
q AS (SELECT feature, target, quantile_cont(v, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(v, CAST(0.5 AS DOUBLE)) AS median,
             quantile_cont(v, CAST(0.75 AS DOUBLE)) AS q3 FROM long GROUP BY ALL)
SELECT feature, target, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(v) FILTER (v >= q1 - (q3 - q1) * 1.5 AND v <= q3 + (q3 - q1) * 1.5), 6) AS whisker_lo,
       round(max(v) FILTER (v >= q1 - (q3 - q1) * 1.5 AND v <= q3 + (q3 - q1) * 1.5), 6) AS whisker_hi,
       round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n
FROM long JOIN q USING (feature, target) GROUP BY feature, target, q.q1, q.median, q.q3""",
        "outliers": """WITH q AS (
  SELECT event_type, quantile_cont(value, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(value, CAST(0.75 AS DOUBLE)) AS q3
  FROM events GROUP BY event_type)
SELECT event_id, event_type, 'value' AS feature, value FROM events JOIN q USING (event_type)
WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5""",
        "density": density_sql(f"{BINARY}, src AS (SELECT * FROM binary_cohort),", "age", "target", 64),
        "density_continuous": density_sql("src AS (SELECT * FROM events),", "value", "event_type", 32),
        "correlation_matrix": f"""WITH {BINARY}
{_rows([f"SELECT '{a}' AS a, '{b}' AS b, round_even({safe(a, b)}, 3) AS r FROM binary_cohort" for a, b in pairs])}""",
        "target_correlation": f"""WITH {BINARY}, t AS (
{_rows([f"SELECT '{c}' AS feature, {safe(c, 'target')} AS r FROM binary_cohort" for c in FEATURES])})
SELECT feature, round(r, 6) AS r, CASE WHEN r > 0 THEN 'raises' WHEN r <= 0 THEN 'lowers' END AS direction FROM t""",
    }


def _cleaning() -> dict[str, str]:
    number = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
    coerce = lambda expr, name: (
        f"CASE WHEN regexp_matches(trim({expr}), {number}) THEN TRY_CAST(trim({expr}) AS DOUBLE) END AS {name}"
    )
    checks = []
    for c in ("age", "cp", "thalach", "slope"):
        d = config.DOMAINS[c]
        if d.options:
            rule = f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} NOT IN ({', '.join(map(str, d.options))}) THEN 'option' END"
        else:
            off = f"abs(({c} - {d.low}) / {d.step} - round(({c} - {d.low}) / {d.step}))"
            rule = (
                f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} < {d.low} THEN 'below' "
                f"WHEN {c} > {d.high} THEN 'above' WHEN {off} > 1e-6 THEN 'step' END"
            )
        checks.append(f"SELECT row_key, '{c}' AS feature, {c} AS value, {rule} AS rule FROM d")
    return {
        "binarise": f"WITH {BINARY} SELECT row_key, target FROM binary_cohort",
        "binarise_guarded": """SELECT doc_id, quality + 1 AS grade,
       CASE WHEN quality + 2 * toxic - 1 > 0 THEN 1 ELSE 0 END AS level FROM labels""",
        "deduplicate": f"WITH {COHORT_SQL} SELECT DISTINCT * FROM cohort",
        "deduplicate_texts": "SELECT DISTINCT lang, text FROM documents",
        "missing_fraction": f"""WITH {COHORT_SQL}, d AS (SELECT DISTINCT * FROM cohort)
SELECT {", ".join(f"round(CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*), 6) AS {c}" for c in ("slope", "ca", "thal"))}
FROM d""",
        "impute_mode": f"""WITH {COHORT_SQL}
SELECT row_key, coalesce(slope, (SELECT slope FROM cohort WHERE slope IS NOT NULL
                                 GROUP BY slope ORDER BY count(*) DESC, slope LIMIT 1)) AS slope FROM cohort""",
        "impute_median": f"""WITH {COHORT_SQL}
SELECT row_key, coalesce(ca, (SELECT quantile_cont(ca, CAST(0.5 AS DOUBLE)) FROM cohort)) AS ca FROM cohort""",
        "coerce_numeric": f"""SELECT c_custkey, {coerce("split_part(c_name, '#', 2)", "plain")},
       {coerce("concat(' ', c_nationkey, ' ')", "padded")}, {coerce("concat(c_nationkey, 'e2')", "exponent")},
       {coerce("concat(c_nationkey, 'd')", "lettered")}, {coerce("c_mktsegment", "word")} FROM customer""",
        "clean_cohort": f"WITH {CLEAN_SQL} SELECT * FROM cleaned",
        "melt": """SELECT p_partkey, 'Size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
        "map_codes": """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent'
       WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority FROM orders""",
        "record_rows": """SELECT p_partkey, 1 AS position, 'p_size' AS parameter, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 2, 'Retail Price', p_retailprice FROM part""",
        "validate_domain": f"""WITH {COHORT_SQL}, d AS (SELECT DISTINCT row_key, age, cp, thalach, slope FROM cohort)
SELECT * FROM ({_rows(checks)}) WHERE rule IS NOT NULL""",
        "stratified_split": f"WITH {SPLIT_SQL} SELECT row_key, target, split FROM marked",
        "scaler_params": f"""WITH {SPLIT_SQL}
{_rows([f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM marked WHERE split = 'train'" for i, c in enumerate(KEPT)])}""",
        "scaled": f"""WITH {SPLIT_SQL}, p AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in KEPT)} FROM marked WHERE split = 'train')
SELECT row_key, target, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 5) AS {c}" for c in KEPT)}
FROM marked, p WHERE split = 'test'""",
    }


# Brute force: every pair of a held-out and a training vector.
NEAREST_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM e GROUP BY y),
s AS (SELECT *, total - ceil(0.2 * total) AS n_train, CAST(n AS DOUBLE) * (total - ceil(0.2 * total)) / total AS share FROM c),
k AS (SELECT y, n - (floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y)
                                               <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END) AS n_test FROM s),
m AS (SELECT e.*, row_number() OVER (PARTITION BY e.y ORDER BY md5(concat_ws('|', '42', vec_id))) <= n_test AS is_test
      FROM e JOIN k ON e.y = k.y),
d AS (SELECT q.vec_id, t.y, t.vec_id AS tid, list_distance(q.x, t.x) AS dist
      FROM m q JOIN m t ON q.is_test AND NOT t.is_test),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, tid) AS place FROM d)
SELECT vec_id, round(avg(y), 6) AS probability, CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END AS prediction
FROM n WHERE place <= 7 GROUP BY vec_id"""


def _evaluation() -> dict[str, str]:
    single = lambda source: f"""WITH t AS ({source}),
g AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM t GROUP BY s),
r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS run FROM g)
SELECT round(sum(neg * (run - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r"""
    place = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(["price", "quantity", "discount"])) + " END"
    medals = "CASE rank " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in config.MEDALS.items()) + " ELSE concat('#', rank) END"
    board = f"""board AS (
  SELECT *, CAST(row_number() OVER (ORDER BY coalesce(roc_auc, 0) DESC, {place}) AS INTEGER) AS rank FROM metrics)"""
    return {
        "classification_metrics": f"WITH {METRICS_SQL} SELECT * FROM metrics",
        "confusion_matrix": f"""WITH {SCORES_SQL},
cells(label, prediction, cell) AS (VALUES (0, 0, 'TN'), (0, 1, 'FP'), (1, 0, 'FN'), (1, 1, 'TP')),
n AS (SELECT model, label, prediction, count(*) AS n FROM scores GROUP BY ALL)
SELECT m.model, c.label, c.prediction, coalesce(n.n, 0) AS count, c.cell
FROM (SELECT DISTINCT model FROM scores) m CROSS JOIN cells c
LEFT JOIN n ON n.model = m.model AND n.label = c.label AND n.prediction = c.prediction""",
        "roc_auc": f"WITH {METRICS_SQL} SELECT model, round(auc, 6) AS roc_auc FROM areas",
        "roc_auc_events": single("SELECT value AS s, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events"),
        "roc_auc_documents": single("SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)"),
        "roc_curve": f"""WITH {METRICS_SQL}
SELECT model, round(score, 9) AS threshold, round(run_neg / all_neg, 9) AS fpr, round(run_pos / all_pos, 9) AS tpr
FROM runs WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM runs""",
        "metrics_long": f"WITH {METRICS_SQL} "
        + _rows(
            [f"SELECT model, {text(n)} AS metric, coalesce(\"{c}\", 0) AS value FROM metrics" for c, n in config.METRIC_NAMES.items()]
        ),
        "leaderboard": f"""WITH {METRICS_SQL}, {board}
SELECT rank, {medals} AS medal, model, accuracy, "precision", recall, f1, roc_auc FROM board""",
        "best_model": f"WITH {METRICS_SQL}, {board} SELECT model, roc_auc FROM board WHERE rank = 1",
        "results_round_trip": f"""WITH {METRICS_SQL}
SELECT m.*, 'linear' AS explains, round(auc, 6) AS auc, CAST(1 AS DOUBLE) AS last_tpr, CAST(1 AS DOUBLE) AS last_fpr
FROM metrics m JOIN areas USING (model)""",
        "ragged_round_trip": """WITH c AS (SELECT *, c_custkey % 10 AS k FROM customer)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN k <> 1 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey,
       CASE WHEN k > 2 THEN round(CAST(c_acctbal AS DOUBLE), 2) END AS c_acctbal,
       CASE WHEN k = 1 THEN 'surplus' ELSE 'row' END AS outcome, CASE WHEN k = 1 THEN CAST(5 AS BIGINT) END AS fields
FROM c""",
        "nearest_scores": NEAREST_SQL,
        "score_stream_neighbours": NEAREST_SQL,
    }


def tree_sql() -> str:
    """The fixed trees over all coalitions: the first one asks for quantity (q) and discount (d), the second for the tax.

    A feature outside the coalition takes both ways, weighted by cover: 60 and 40 of 100, 10 and 30 of 40; 16, 24 and 40 of 80.
    """
    return _with_rows(f"""v AS (
  SELECT {KEY_SQL} AS row_key, CASE WHEN l_quantity <= 24.5 THEN 1 ELSE 0 END AS q,
         CASE WHEN l_discount <= 0.05 THEN CAST(0.5 AS DOUBLE) ELSE 0.9 END AS d, CAST(0.25 * 0.5 + 0.75 * 0.9 AS DOUBLE) AS any_d,
         CASE WHEN l_tax <= 0.025 THEN CAST(-1 AS DOUBLE) WHEN l_tax <= 0.05 THEN 0.5 ELSE 1 END AS tax,
         CAST((16 * -1.0 + 24 * 0.5 + 40 * 1.0) / 80 AS DOUBLE) AS any_tax
  FROM lineitem),
w AS (
  SELECT *, 0.6 * 0.2 + 0.4 * any_d AS v_none, CASE WHEN q = 1 THEN 0.2 ELSE any_d END AS only_q, 0.6 * 0.2 + 0.4 * d AS only_d,
         CASE WHEN q = 1 THEN 0.2 ELSE d END AS v_both FROM v)""", [
        ("l_quantity", "((only_q - v_none) + (v_both - only_d)) / 2"), ("l_discount", "((only_d - v_none) + (v_both - only_q)) / 2"), ("l_tax", "tax - any_tax"),
    ])


def _with_rows(tables: str, phis: list[tuple[str, str]]) -> str:
    return f"WITH {tables} " + _rows(
        [f"SELECT row_key, '{c}' AS feature, round({phi}, 6) AS phi, round(v_none + any_tax, 6) AS base_value FROM w" for c, phi in phis]
    )


def _scoring() -> dict[str, str]:
    band = lambda p, a, b: f"CASE WHEN {p} < {a} THEN 'Low' WHEN {p} < {b} THEN 'Moderate' WHEN {p} IS NOT NULL THEN 'High' END"
    messages = "CASE risk " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in config.RISK_MESSAGES.items()) + " END"
    banded = f"{CUSTOMER_SQL}, banded AS (SELECT *, {band('probability', 0.35, 0.65)} AS risk FROM risk_base)"
    conf = "greatest(probability, 1 - probability)"
    diagnosis = "CASE WHEN prediction = 1 THEN 'Positive' ELSE 'Negative' END"
    pct = lambda e: f"printf('%.1f%%', {e} * 100)"
    report = [
        ("header", "Generated on", "'March 05, 2024 at 14:07'"),
        ("header", "Report ID", "concat('20240305140709-', c_custkey)"),
        ("summary", "PREDICTION RESULT", "risk"),
        ("summary", "PROBABILITY", pct("probability")),
        ("summary", "CONFIDENCE", pct(conf)),
        ("summary", "DIAGNOSIS", diagnosis),
        ("summary", "MODEL USED", "'price'"),
        ("input", "Balance", "CAST(c_acctbal AS VARCHAR)"),
        ("input", "C_Nationkey", "CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR)"),
    ] + [
        ("metrics", n, f"(SELECT printf('%.4f', \"{c}\") FROM metrics WHERE model = 'price')")
        for c, n in config.METRIC_NAMES.items()
    ]
    weights = {"l_quantity": 0.8, "l_extendedprice": -0.4, "l_discount": 1.2, "l_tax": 0.5}
    z = " + ".join(f"{w} * ({c} - m_{c}) / s_{c}" for c, w in weights.items())
    params = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in weights)
    scored = f"""WITH p AS (SELECT {params} FROM lineitem),
s AS (SELECT {KEY_SQL} AS row_key, 1 / (1 + exp(-(CAST(-0.3 AS DOUBLE) + {z}))) AS probability FROM lineitem, p),
t AS (SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM s)
SELECT row_key, round(probability, 6) AS probability, prediction, round({conf}, 6) AS confidence,
       {diagnosis} AS diagnosis, {band('probability', 0.35, 0.65)} AS risk, 1 AS n_defaulted FROM t"""
    line = {"l_quantity": 0.0317, "l_extendedprice": 0.00002, "l_discount": -4.0, "l_tax": 6.0}
    base = " + ".join(f"CAST({w} AS DOUBLE) * (SELECT avg({c}) FROM lineitem)" for c, w in line.items())
    phi = "phi AS (" + _rows(
        [
            f"SELECT {KEY_SQL} AS row_key, '{c}' AS feature, CAST({w} AS DOUBLE) * ({c} - (SELECT avg({c}) FROM lineitem)) AS phi FROM lineitem"
            for c, w in line.items()
        ]
    ) + ")"
    top = f"""WITH {phi}, r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row_key ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM phi)
SELECT row_key, feature, round(phi, 6) AS phi, rank, CASE WHEN phi > 0 THEN 'raises' ELSE 'lowers' END AS direction
FROM r WHERE rank <= 2"""
    return {
        "risk_band": f"WITH {banded} SELECT c_custkey, round(probability, 6) AS probability, risk, {messages} AS message FROM banded",
        "gauge_band": f"""WITH {CUSTOMER_SQL} SELECT c_custkey, round(probability * 100, 6) AS gauge_value,
       round(probability * 100 - 50, 6) AS gauge_delta, {band('probability', 0.4, 0.65)} AS gauge_band FROM risk_base""",
        "confidence": f"""WITH {CUSTOMER_SQL} SELECT c_custkey, prediction, round({conf}, 6) AS confidence,
       {diagnosis} AS diagnosis FROM risk_base""",
        "score_records": scored,
        "score_stream": scored,
        "report_rows": f"WITH {banded}, {METRICS_SQL} "
        + _rows(
            [
                f"SELECT c_custkey, '{s}' AS section, {i} AS position, {text(n)} AS label, {v} AS value FROM banded"
                for i, (s, n, v) in enumerate(report, 1)
            ]
        ),
        "explain_linear": f"""WITH {phi} SELECT row_key, feature, round(phi, 6) AS phi,
       round((SELECT CAST(-1.5 AS DOUBLE) + {base}), 6) AS base_value, 'log_odds' AS output_space FROM phi""",
        "explain_tree_fixed": tree_sql(),
        # The weighted mean over the groups' means is the mean of all lines.
        "explain_sampled_linear": f"""WITH {phi} SELECT row_key, feature, round(phi, 6) AS phi,
       round((SELECT CAST(-1.5 AS DOUBLE) + {base}), 6) AS base_value FROM phi""",
        "top_contributions": top,
        "top_contributions_stored": top,
        "global_importance": f"WITH {phi} SELECT feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY feature",
    }


def all_oracles() -> dict[str, str]:
    return _quality() | _shapes() | _cleaning() | _evaluation() | _scoring()
