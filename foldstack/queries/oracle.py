"""ANSI SQL twins of the relational queries, over the shared table names.

Each statement is written from the definition of the operator, in long form with window functions
where the Spark side uses array expressions, so the two sides share no logic.
"""

from __future__ import annotations

from foldstack.operators.splits import FOLDS, SEED
from foldstack.queries.fixtures import N_CLASSES, SLICES, positions

WINDOWS = """windows AS (
  SELECT CAST(vec_id AS VARCHAR) AS window_id, 'c' || CAST(label AS VARCHAR) AS label,
         CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings)"""

LARGE = """large AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d')) AS window_id,
         l_returnflag AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS features,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

#: The same rows labelled by their order.
ORDER = LARGE.replace("l_returnflag AS label", "CAST(l_orderkey AS VARCHAR) AS label")

CELLS = """cells AS (
  SELECT window_id, label, CAST((i - 1) // 4 AS INTEGER) AS t, CAST((i - 1) % 4 AS INTEGER) AS c,
         features[i] AS x
  FROM (SELECT window_id, label, features, unnest(range(1, len(features) + 1)) AS i FROM windows))"""


def _scored(name: str, step: int) -> str:
    """Pseudo predictions from the embedding: probabilities, first maximum, class code."""
    values = ", ".join(
        " + ".join(f"abs(CAST(embedding[{p}] AS DOUBLE))" for p in positions(step, i)) for i in range(N_CLASSES)
    )
    total = " + ".join(f"a[{i + 1}]" for i in range(N_CLASSES))
    return f"""{name} AS (
  SELECT window_id, label, label AS actual, y, 'c' || CAST(guess AS VARCHAR) AS predicted, guess,
         [v / total FOR v IN a] AS proba, top / total AS conf
  FROM (SELECT CAST(vec_id AS VARCHAR) AS window_id, 'c' || CAST(label AS VARCHAR) AS label,
               label AS y, a, {total} AS total, list_max(a) AS top,
               CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS guess
        FROM (SELECT *, [{values}] AS a FROM embeddings)))"""


PRED = _scored("pred", 1)
OOF = (
    ", ".join(_scored(f"scored_{m}", start) for m, start in SLICES.items())
    + ", oof AS ("
    + " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM scored_{m}" for m in SLICES)
    + ")"
)

BINARY = """pred AS (
  SELECT doc_id, quality AS y, CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END AS guess,
         greatest(p1, 1 - p1) AS conf
  FROM (SELECT l.doc_id, l.quality, (d.n_chars % 1001) / 1000.0::DOUBLE AS p1
        FROM labels l JOIN documents d USING (doc_id)))"""

LARGE_PRED = """pred AS (
  SELECT model, y, proba, list_max(proba) AS conf,
         CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS guess
  FROM (SELECT l_linestatus AS model,
               CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER) AS y,
               [q / (q + d + x), d / (q + d + x), x / (q + d + x)] AS proba
        FROM (SELECT *, l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 12 AS x FROM lineitem)))"""

EVENTS = """raw AS (
  SELECT CAST(event_id AS VARCHAR) AS window_id, event_type = 'error' AS no_label,
         event_type = 'signup' AS no_features, event_type = 'click' AS unreadable,
         event_type = 'purchase' AS null_element
  FROM events)"""

DOC_OOF = """folds AS (SELECT CAST(doc_id AS VARCHAR) AS window_id, lang AS label FROM documents),
oof AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS window_id, d.source AS model, l.quality, l.toxic
  FROM labels l JOIN documents d USING (doc_id))"""

HASHES = """checked AS (
  SELECT 'doc-' || CAST(d.doc_id AS VARCHAR) AS rel_path, coalesce(l.quality = 1, false) AS ok
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _folds(source: str, k: int = FOLDS, seed: int = SEED) -> str:
    """Fold of each row: quotas per class by residues of the running class offset."""
    return f"""sizes AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
offsets AS (SELECT label, n, CAST(sum(n) OVER (ORDER BY md5(label)) - n AS BIGINT) AS o FROM sizes),
quotas AS (
  SELECT label, f, (o + n - 1 - f + {k}) // {k} - (o - 1 - f + {k}) // {k} AS q
  FROM offsets, (SELECT unnest(range({k})) AS f)),
cuts AS (SELECT label, f, q, sum(q) OVER (PARTITION BY label ORDER BY f) AS hi FROM quotas),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY md5('{seed}:' || window_id), window_id) - 1 AS r FROM {source}),
folded AS (
  SELECT ranked.*, CAST(f AS INTEGER) AS fold FROM ranked JOIN cuts USING (label)
  WHERE r >= hi - q AND r < hi)"""


def _holdout(source: str) -> str:
    return f"""WITH {source}, sizes AS (SELECT label, count(*) AS n FROM large GROUP BY label),
        target AS (SELECT sum(n)::BIGINT AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS test FROM sizes),
        shares AS (SELECT label, n * test // total AS low, n * test % total AS rest, test FROM sizes, target),
        quota AS (SELECT label, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                  <= test - sum(low) OVER () THEN 1 ELSE 0 END AS q FROM shares),
        ranked AS (SELECT window_id, label, row_number() OVER (PARTITION BY label
                   ORDER BY md5('{SEED}:' || window_id), window_id) - 1 AS r FROM large)
        SELECT window_id, label, r < q AS is_test FROM ranked JOIN quota USING (label)"""


def _trained(model: str, table: str) -> str:
    return f"""SELECT '{model}' AS model, part, n, true AS in_range FROM (
        SELECT 'test' AS part, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n FROM {table}
        UNION ALL SELECT 'train', count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) FROM {table})"""


def _evaluated(model: str) -> str:
    return f"""SELECT '{model}' AS model, CAST({SEED} AS BIGINT) AS seed, {FOLDS} AS cv_folds, CAST(f AS INTEGER) AS fold,
        n > 0 AS stamped, n > 0 AS in_range FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest(range({FOLDS})) AS f)"""


# The checks of a full audit over the base models.
_MODELS = ("logreg", "rf", "xgb", "rwkv_ts", "cnn_transformer")
AUDITED = [
    *[("all", c) for c in ("manifest", "manifest files", "training schema")],
    ("base", "training table"),
    ("base", "metric ranges"),
    *[("base", f"{what} {m}") for m in _MODELS for what in ("model", "metrics")],
    ("oof", "split"),
    ("oof", "split version"),
    *[("oof", f"{what} {m}") for m in _MODELS for what in ("rows", "coverage", "version")],
    *[("stack", c) for c in ("model stack", "metric ranges", "acceptance")],
]


def _bin(conf: str) -> str:
    edges = " + ".join(
        f"CAST({conf} > {i}::DOUBLE * 0.1::DOUBLE AS INTEGER)" for i in range(10)
    )
    return f"({edges} + CAST({conf} > 1.0::DOUBLE AS INTEGER))"


def _report(source: str, by: str = "") -> str:
    """Per-class precision, recall and F1 by group; ``by`` is a column list ending in a comma."""
    keys = [k for k in by.replace(" ", "").split(",") if k]
    on = " AND ".join([f"u.{k} = p.{k}" for k in keys] + ["(p.actual = u.class OR p.predicted = u.class)"])
    u_keys = "".join(f"u.{k}, " for k in keys)
    return f"""per_class AS (
  SELECT {u_keys}u.class, count(*) FILTER (WHERE p.actual = u.class) AS support,
         count(*) FILTER (WHERE p.predicted = u.class) AS chosen,
         count(*) FILTER (WHERE p.actual = u.class AND p.predicted = u.class) AS hits
  FROM (SELECT {by} actual AS class FROM {source} UNION SELECT {by} predicted FROM {source}) u
  JOIN {source} p ON {on} GROUP BY {u_keys}u.class),
report AS (
  SELECT *, CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
         CASE WHEN chosen + support > 0 THEN 2 * hits / (chosen + support) ELSE 0 END AS f1
  FROM per_class)"""


def _mean(weight: str) -> str:
    parts = [f"sum({m} * {weight}) / sum({weight})" for m in ("precision", "recall", "f1")]
    return ", ".join(f"{p} AS {m}" for p, m in zip(parts, ("precision", "recall", "f1")))


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in columns)


def _bundle(source: str) -> str:
    """Metric bundle per model from prediction rows with y, guess, conf and proba."""
    return f"""rows AS (
  SELECT model, y AS actual, guess AS predicted, conf, {_bin("conf")} AS bin,
         -ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, proba[y + 1]))) AS loss,
         len(proba) AS width FROM {source}),
{_report("rows", "model,")},
macro AS (SELECT model, {_mean("1.0")} FROM report GROUP BY model),
plain AS (
  SELECT model, avg(CAST(actual = predicted AS DOUBLE)) AS accuracy,
         CASE WHEN count(DISTINCT actual) = max(width) THEN avg(loss) END AS logloss
  FROM rows GROUP BY model),
gaps AS (
  SELECT model, count(*) AS n, abs(sum(conf) - sum(CAST(actual = predicted AS DOUBLE))) AS gap, bin
  FROM rows GROUP BY model, bin),
calibration AS (
  SELECT model, sum(CASE WHEN bin BETWEEN 1 AND 10 THEN gap ELSE 0 END) / sum(n) AS ece
  FROM gaps GROUP BY model),
bundle AS (
  SELECT model, accuracy, precision, recall, f1, ece, logloss
  FROM plain JOIN macro USING (model) JOIN calibration USING (model))"""


def _ece(source: str) -> str:
    return f"""binned AS (SELECT {_bin("conf")} AS bin, conf, CAST(y = guess AS DOUBLE) AS hit FROM {source}),
gaps AS (SELECT bin, count(*) AS n, abs(avg(conf) - avg(hit)) AS gap FROM binned GROUP BY bin)
SELECT round(sum(CASE WHEN bin BETWEEN 1 AND 10 THEN gap * n ELSE 0 END) / sum(n), 6) AS ece FROM gaps"""


TOTALS = (
    "SELECT window_id, label, CAST(len(features) AS INTEGER) AS n_features, "
    "round(list_sum(features), 6) + 0.0::DOUBLE AS total FROM "
)
SERIES = "PARTITION BY window_id, c"
LAG = f"coalesce(lag(x) OVER ({SERIES} ORDER BY t), 0)"


def _value(expression: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE AS value"


def _conv(size: int, block: int) -> str:
    window = f"{SERIES} ORDER BY t ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW"
    return (
        f"SELECT window_id, t, CAST(c + {4 * block} AS INTEGER) AS c, "
        f"{_value(f'sum(x) OVER ({window}) / {size}')} FROM cells"
    )


def _patch(size: int) -> str:
    return (
        f"SELECT window_id, {size} AS size, CAST(t // {size} AS INTEGER) AS p, c, {_value('avg(x)')} "
        f"FROM cells GROUP BY window_id, t // {size}, c"
    )


def _uniform(draw: int) -> str:
    text = f"'{SEED}:' || CAST(vec_id AS VARCHAR) || ':' || CAST(c AS VARCHAR) || ':{draw}'"
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


_FOLD_PRED = f"WITH {PRED}, {_folds('pred')}"

ORACLE: dict[str, str] = {
    "label_distribution": f"WITH {LARGE} SELECT label, count(*) AS n FROM large GROUP BY label",
    "dataset_profile": f"""WITH {LARGE} SELECT count(*) AS n_rows, CAST(3 AS INTEGER) AS n_cols,
        'window_id,label,features' AS columns FROM large""",
    "dataset_expectations": """WITH c AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM embeddings)
        SELECT 'num_rows' AS "check", '500' AS expected, n AS actual, n = '500' AS ok FROM c
        UNION ALL SELECT 'num_cols', '3', '3', true
        UNION ALL SELECT 'columns', 'window_id,label,features', 'window_id,label,features', true""",
    "class_list": f"""WITH {WINDOWS} SELECT string_agg(label, ',' ORDER BY label) AS classes,
        count(*) AS n_classes FROM (SELECT DISTINCT label FROM windows)""",
    "windows_conformed": f"WITH {WINDOWS} {TOTALS} windows",
    "contract_violations": f"""WITH {EVENTS}
        SELECT window_id, 'missing_label' AS rule FROM raw WHERE no_label
        UNION ALL SELECT window_id, 'missing_features' FROM raw WHERE no_features
        UNION ALL SELECT window_id, 'unreadable_features' FROM raw WHERE unreadable
        UNION ALL SELECT window_id, 'non_numeric_feature' FROM raw WHERE null_element""",
    "violation_counts": f"""WITH {EVENTS} SELECT count(*) AS n_rows,
        count(*) FILTER (WHERE window_id IS NULL) AS missing_window_id, count(*) FILTER (WHERE no_label) AS missing_label,
        count(*) FILTER (WHERE no_features) AS missing_features, count(*) FILTER (WHERE unreadable) AS unreadable_features,
        count(*) FILTER (WHERE null_element) AS non_numeric_feature FROM raw""",
    "duplicate_ids": """SELECT CAST(l_orderkey AS VARCHAR) AS window_id, count(*) AS copies
        FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
    "wide_to_features": f"""WITH {LARGE} SELECT window_id, label, l_quantity AS f0,
        l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM large""",
    "json_features": f"WITH {WINDOWS} {TOTALS} windows",
    "csv_round_trip": f"WITH {WINDOWS} {TOTALS} windows",
    "json_round_trip": f"WITH {LARGE} {TOTALS} large",
    "feature_dimension": f"""WITH {WINDOWS} SELECT CAST(min(len(features)) AS INTEGER) AS min_dim,
        CAST(max(len(features)) AS INTEGER) AS max_dim,
        count(DISTINCT len(features)) = 1 AS uniform FROM windows""",
    "vector_round_trip": f"WITH {WINDOWS} {TOTALS} windows",
    "label_codes": f"""WITH {LARGE} SELECT window_id, label,
        CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM large""",
    "many_label_codes": f"""WITH {ORDER} SELECT window_id, label,
        CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM large""",
    "many_label_weights": f"""WITH {ORDER}, n AS (SELECT label, count(*) AS n FROM large GROUP BY label)
        SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n""",
    "many_label_folds": f"WITH {ORDER}, {_folds('large')} SELECT window_id, label, fold FROM folded",
    "many_label_holdout": _holdout(ORDER),
    "label_index": f"""WITH {WINDOWS} SELECT window_id, label,
        CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM windows""",
    "label_decode": f"WITH {PRED} SELECT window_id, guess, predicted AS decoded FROM pred",
    "class_weights": f"""WITH {LARGE}, n AS (SELECT label, count(*) AS n FROM large GROUP BY label)
        SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n""",
    "stratified_folds": f"WITH {WINDOWS}, {_folds('windows')} SELECT window_id, label, fold FROM folded",
    "stratified_folds_large": f"WITH {LARGE}, {_folds('large')} SELECT window_id, label, fold FROM folded",
    "stratified_folds_by_rank": f"WITH {LARGE}, {_folds('large')} SELECT window_id, label, fold FROM folded",
    "fold_sizes": f"""WITH {LARGE}, {_folds('large')}
        SELECT label, fold, count(*) AS n FROM folded GROUP BY label, fold""",
    "holdout_split": _holdout(LARGE),
    "train_valid_counts": f"""WITH {WINDOWS}, {_folds('windows')},
        f AS (SELECT fold, count(*) AS n FROM folded GROUP BY fold)
        SELECT fold, 'valid' AS side, n FROM f
        UNION ALL SELECT fold, 'train', CAST(sum(n) OVER () - n AS BIGINT) FROM f""",
    "folds_joined": f"""WITH {LARGE}, {_folds('large')}
        SELECT fold, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM folded GROUP BY fold""",
    "argmax_confidence": f"""WITH {PRED} SELECT window_id, guess, {_r('conf')},
        CAST(guess = y AS DOUBLE) AS hit FROM pred""",
    "softmax_rows": f"""WITH {WINDOWS}, flat AS (SELECT window_id, i, features[i] AS x
        FROM (SELECT window_id, features, unnest(range(1, len(features) + 1)) AS i FROM windows))
        SELECT window_id, CAST(i - 1 AS INTEGER) AS c,
        {_value('exp(x) / sum(exp(x)) OVER (PARTITION BY window_id)')} FROM flat""",
    "prediction_table": f"""WITH {PRED} SELECT window_id, predicted AS prediction, {", ".join(
        f"round(proba[{i + 1}], 6) AS prob_class_{i}" for i in range(N_CLASSES))} FROM pred""",
    "accuracy_by_fold": f"""{_FOLD_PRED} SELECT fold,
        round(avg(CAST(actual = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS n
        FROM folded GROUP BY fold""",
    "fold_metrics": f"""{_FOLD_PRED}, {_report('folded', 'fold,')},
        m AS (SELECT fold, sum(hits) / sum(support) AS accuracy, {_mean('support')}, avg(f1) AS macro_f1
              FROM report GROUP BY fold)
        SELECT fold, {_r('accuracy', 'precision', 'recall', 'f1', 'macro_f1')} FROM m""",
    "fold_mean_metrics": f"""{_FOLD_PRED}, {_report('folded', 'fold,')},
        m AS (SELECT fold, sum(hits) / sum(support) AS accuracy, {_mean('support')}
              FROM report GROUP BY fold)
        SELECT count(*) AS folds, round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision,
               round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m""",
    "confusion_long": f"""WITH {PRED}, classes AS (SELECT DISTINCT label AS class FROM pred)
        SELECT a.class AS actual, b.class AS predicted, count(pred.window_id) AS n
        FROM classes a CROSS JOIN classes b
        LEFT JOIN pred ON pred.actual = a.class AND pred.predicted = b.class GROUP BY ALL""",
    "confusion_wide": f"""WITH {PRED} SELECT actual, {", ".join(
        f"count(*) FILTER (WHERE predicted = 'c{i}') AS c{i}" for i in range(N_CLASSES))} FROM pred GROUP BY actual""",
    "class_report": f"""WITH {PRED}, {_report('pred')}
        SELECT class, support, {_r('precision', 'recall', 'f1')} FROM report""",
    "report_weighted": f"""WITH {PRED}, {_report('pred')}, m AS (SELECT {_mean('support')} FROM report)
        SELECT {_r('precision', 'recall', 'f1')} FROM m""",
    "report_macro": f"""WITH {PRED}, {_report('pred')}, m AS (SELECT {_mean('1.0')} FROM report)
        SELECT {_r('precision', 'recall', 'f1')} FROM m""",
    "ece_binary": f"WITH {BINARY}, {_ece('pred')}",
    "ece_multiclass": f"WITH {PRED}, {_ece('pred')}",
    "reliability_bins": f"""WITH {LARGE_PRED} SELECT model, {_bin('conf')} AS bin, count(*) AS n,
        round(sum(conf), 6) AS sum_conf, round(sum(CAST(y = guess AS DOUBLE)), 6) AS sum_hit
        FROM pred GROUP BY 1, 2""",
    "log_loss": f"""WITH {PRED} SELECT CASE WHEN count(DISTINCT y) = max(len(proba)) THEN
        round(avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, proba[y + 1])))), 6)
        END AS logloss FROM pred""",
    "metric_bundle": f"""WITH {OOF}, {_bundle('oof')}
        SELECT model, {_r('accuracy', 'precision', 'recall', 'f1', 'ece', 'logloss')} FROM bundle""",
    "metric_bundle_large": f"""WITH {LARGE_PRED}, {_bundle('pred')}
        SELECT model, {_r('accuracy', 'precision', 'recall', 'f1', 'ece', 'logloss')} FROM bundle""",
    "stack_matrix": f"""WITH {OOF}, flat AS (SELECT window_id, model, proba,
        unnest(range(1, {N_CLASSES + 1})) AS i FROM oof)
        SELECT window_id, CAST(i - 1 + {N_CLASSES} * CAST(substr(model, 2) AS INTEGER) AS INTEGER) AS c,
        {_value('proba[i]')} FROM flat""",
    "stack_with_labels": f"""WITH {OOF} SELECT window_id, label,
        CAST(sum(len(proba)) AS INTEGER) AS width, round(sum(list_sum(proba)), 6) AS total
        FROM oof GROUP BY window_id, label""",
    "oof_zero_rows": f"""WITH {DOC_OOF} SELECT model, count(*) AS n_rows,
        count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS zero_rows FROM oof GROUP BY model""",
    "oof_missing": f"""WITH {DOC_OOF} SELECT window_id, label FROM folds
        WHERE window_id NOT IN (SELECT window_id FROM oof)""",
    "oof_coverage": f"""WITH {DOC_OOF} SELECT 'labels' AS model, count(oof.window_id) AS n_rows,
        count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS zero_rows, count(*) FILTER (WHERE oof.window_id IS NULL) AS missing_rows,
        CAST(0 AS BIGINT) AS extra_rows, CAST(0 AS BIGINT) AS duplicate_rows
        FROM folds LEFT JOIN oof USING (window_id)""",
    "oof_coverage_faults": f"""WITH {DOC_OOF}, faulty AS (
          SELECT 'doubled' AS model, CAST(2 * CAST(window_id AS BIGINT) AS VARCHAR) AS window_id, quality, toxic FROM oof
          UNION ALL SELECT 'plain', window_id, quality, toxic FROM oof
          UNION ALL SELECT 'repeated', window_id, quality, toxic FROM oof
          UNION ALL SELECT 'repeated', window_id, quality, toxic FROM oof WHERE quality = 0),
        names AS (SELECT DISTINCT model FROM faulty)
        SELECT model, (SELECT count(*) FROM faulty x WHERE x.model = n.model) AS n_rows,
          (SELECT count(*) FROM faulty x WHERE x.model = n.model AND quality = 0 AND toxic = 0) AS zero_rows,
          (SELECT count(*) FROM folds WHERE window_id NOT IN (SELECT window_id FROM faulty x WHERE x.model = n.model)) AS missing_rows,
          (SELECT count(*) FROM faulty x WHERE x.model = n.model AND window_id NOT IN (SELECT window_id FROM folds)) AS extra_rows,
          (SELECT count(*) - count(DISTINCT window_id) FROM faulty x WHERE x.model = n.model) AS duplicate_rows FROM names n""",
    "stack_acceptance": f"""WITH {OOF}, {_bundle('oof')},
        best AS (SELECT max(f1) FILTER (model = 'm2') AS stack_f1, max(ece) FILTER (model = 'm2') AS stack_ece,
                 coalesce(max(f1) FILTER (model <> 'm2'), 0) AS best_base_f1 FROM bundle)
        SELECT {_r('stack_f1', 'stack_ece', 'best_base_f1')},
               round((stack_f1 - best_base_f1) * 100, 6) + 0.0::DOUBLE AS gain_points,
               (stack_f1 - best_base_f1) * 100 >= 2 OR stack_ece <= 0.03 AS accepted FROM best""",
    "metric_ranges": f"""WITH scores AS (
          SELECT c_name AS model, 'accuracy' AS metric, c_acctbal / 10000 AS value FROM customer
          UNION ALL SELECT c_name, 'recall', c_acctbal / 5000 FROM customer
          UNION ALL SELECT c_name, 'auc', c_acctbal / 8000 FROM customer WHERE c_mktsegment <> 'BUILDING')
        SELECT model, metric, value FROM scores WHERE value < 0 OR value > 1""",
    "metric_ranges_custom": """WITH scores AS (
          SELECT CAST(o_orderkey AS VARCHAR) AS model, 'macro_f1' AS metric, o_totalprice / 200000 AS value FROM orders
          UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, o_totalprice / 300000 FROM orders
          UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lift', o_totalprice / 400000 FROM orders WHERE o_orderstatus = 'F')
        SELECT model, metric, value FROM scores WHERE value < 0 OR value > 1""",
    "audit_verdict": f"""WITH {DOC_OOF}, checks AS (SELECT model,
          CASE WHEN count(*) FILTER (WHERE quality = 0 AND toxic = 0) > 0 THEN 'fail' ELSE 'ok' END AS status
          FROM oof GROUP BY model)
        SELECT bool_and(status <> 'fail') AS passed, count(*) FILTER (WHERE status = 'fail') AS n_fail,
               count(*) FILTER (WHERE status = 'warn') AS n_warn FROM checks""",
    "hash_verification": f"WITH {HASHES} SELECT rel_path, ok FROM checked",
    "first_failures": f"""WITH {HASHES} SELECT rel_path FROM checked WHERE NOT ok
        ORDER BY rel_path LIMIT 5""",
    "value_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "seq_reshape": f"WITH {WINDOWS}, {CELLS} SELECT window_id, t, c, {_value('x')} FROM cells",
    "seq_instance_norm": f"""WITH {WINDOWS}, {CELLS} SELECT window_id, t, c,
        {_value(f'(x - avg(x) OVER ({SERIES})) / sqrt(var_pop(x) OVER ({SERIES}) + 1e-5)')} FROM cells""",
    "seq_shift": f"WITH {WINDOWS}, {CELLS} SELECT window_id, t, c, {_value(LAG)} FROM cells",
    "seq_mix": f"WITH {WINDOWS}, {CELLS} SELECT window_id, t, c, {_value(f'x * 0.3 + {LAG} * (1 - 0.3)')} FROM cells",
    "seq_causal_conv": f"WITH {WINDOWS}, {CELLS} "
    + " UNION ALL ".join(_conv(size, block) for block, size in enumerate((3, 5, 7))),
    "seq_pool": f"""WITH {WINDOWS}, {CELLS} SELECT window_id, c,
        round(max_by(x, t), 6) + 0.0::DOUBLE AS last_value,
        round(avg(x), 6) + 0.0::DOUBLE AS mean_value FROM cells GROUP BY window_id, c""",
    "seq_patch": f"WITH {WINDOWS}, {CELLS} "
    + " UNION ALL ".join(_patch(size) for size in (7, 15, 21, 35)),
    "synthetic_windows": f"""WITH ids AS (SELECT vec_id, unnest(range(10)) AS c FROM embeddings)
        SELECT CAST(vec_id AS VARCHAR) AS window_id,
               CASE WHEN vec_id % 2 = 0 THEN 'class_A' ELSE 'class_B' END AS label,
               CAST(c AS INTEGER) AS c,
               {_value(f'sqrt(-2 * ln({_uniform(0)})) * cos(2 * pi() * {_uniform(1)})')} FROM ids""",
    "split_reuse": f"WITH {WINDOWS}, {_folds('windows')} SELECT window_id, label, fold FROM folded",
    "oof_stored_coverage": f"""SELECT unnest({list(_MODELS)}) AS model,
        n AS n_rows, CAST(0 AS BIGINT) AS zero_rows, CAST(0 AS BIGINT) AS missing_rows,
        CAST(0 AS BIGINT) AS extra_rows, CAST(0 AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS n FROM embeddings)""",
    "predicted_totals": """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_windows,
        count(*) AS n_normalised FROM embeddings""",
    **{
        f"oof_{query}": f"""WITH {WINDOWS}, {_folds('windows')}
        SELECT window_id, fold, '{model}' AS model, true AS sound FROM folded"""
        for query, model in {"logreg": "logreg", "rf": "rf", "gbt": "xgb", "seq_shift": "rwkv_ts", "seq_conv": "cnn_transformer"}.items()
    },
    "oof_large": f"WITH {LARGE}, {_folds('large')} SELECT window_id, fold, true AS sound FROM folded",
    "oof_boosted_pairs": f"""WITH {LARGE}, two AS (SELECT * FROM large WHERE label IN ('A', 'R')), {_folds('two')}
        SELECT window_id, fold, true AS sound FROM folded""",
    "oof_fold_report": f"""WITH {WINDOWS}, {_folds('windows')}
        SELECT fold, count(*) AS n, true AS in_range FROM folded GROUP BY fold""",
    "split_renewed": f"WITH {WINDOWS}, {_folds('windows')} SELECT window_id, label, fold FROM folded",
    "train_model": f"""SELECT unnest(['logreg', 'rf', 'xgb']) AS model, part, n, in_range, true AS learned
        FROM ({_trained("any", "embeddings")})""",
    "forest_out_of_bag": """SELECT n AS n_rows, n AS n_windows, n AS n_voted, n AS n_sound
        FROM (SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM embeddings)""",
    "train_large": _trained("logreg", "lineitem"),
    "evaluate_model": _evaluated("logreg"),
    "evaluate_stored": _evaluated("rwkv_ts"),
    "stack_train": _evaluated("stack"),
    "run_log": """SELECT unnest(['first', 'second']) AS run_id, 'logreg' AS model, 'abc1234' AS git_sha, true AS shaped, n AS n_windows
        FROM (SELECT count(*) AS n FROM embeddings)""",
    **dict.fromkeys(
        ("predict_model", "predictions_csv", "stack_predict"),
        "SELECT CAST(vec_id AS VARCHAR) AS window_id, true AS known_class, true AS sound FROM embeddings",
    ),
    "audit_all": f"""SELECT unnest({[s for s, _ in AUDITED]}) AS section, unnest({[c for _, c in AUDITED]}) AS "check",
        count(*) > 0 AS passed FROM embeddings""",
    "artifact_manifest": """SELECT unnest(['whole', 'streamed']) AS way, n AS n_files, n AS n_paths, n AS n_hashes,
        CAST(0 AS BIGINT) AS n_errors FROM (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)""",
    "manifest_verify": """SELECT l_returnflag <> 'R' AS ok, count(DISTINCT l_returnflag) AS n_files FROM lineitem GROUP BY 1""",
    "manifest_ranges": """SELECT DISTINCT l_returnflag AS label, true AS several, true AS gapless,
        l_returnflag = 'R' AS changed FROM lineitem""",
    "verify_one_file": "SELECT DISTINCT l_returnflag AS label, true AS own, false AS other FROM lineitem",
    "ingest": f"WITH {LARGE} SELECT label, count(*) AS n FROM large GROUP BY label",
}
