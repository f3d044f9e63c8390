"""Classification, detection, reactions, model responses, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.operators import classify as ops
from threadwise.operators import learned, metrics, responses
from threadwise.operators.repeats import is_repeat
from threadwise.plans.registry import common as c
from threadwise.plans.registry.common import L, STOP, table
from threadwise.session import reliable


def e1_lexicon_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.lexicon_scores(c.turns(spark, sf), L)
    return rows.select("query_id", *[F.get("scores", i).alias(t) for i, t in enumerate(L.taxonomy)])


def e2_classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    return c.classify(c.turns(spark, sf)).select(
        "query_id", "classification.intent", "classification.runner_up", "classification.confidence"
    )


def e3_context_override(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.lexicon_scores(ops.detect_context(c.turns(spark, sf), L), L)
    scores = ops.context_override("scores", F.col("safety.is_safety"), L, 3)
    return rows.select("query_id", F.array_join(scores, ",").alias("scores"))


def e4_needs_context(spark: SparkSession, sf: str) -> DataFrame:
    return c.classify(c.turns(spark, sf)).select("query_id", "classification.needs_context")


def e5_detect_context(spark: SparkSession, sf: str) -> DataFrame:
    return ops.detect_context(c.turns(spark, sf), L).select(
        "query_id", "safety.is_safety", F.array_join("safety.triggers", ",").alias("triggers")
    )


def e6_compare_detectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.compare_detectors(ops.detect_context(c.turns(spark, sf), L), L)
    return rows.select("query_id", F.array_join("naive_hits", ",").alias("naive_hits"), "verdict")


def e7_frustration(spark: SparkSession, sf: str) -> DataFrame:
    return ops.frustration(c.turns(spark, sf), L).select(
        "query_id", F.size("frustration_hits").alias("n_markers"), "frustrated"
    )


def e8_is_deflection(spark: SparkSession, sf: str) -> DataFrame:
    replies = c.turns(spark, sf, "assistant")
    return replies.select("query_id", ops.deflection(F.col("text"), L).alias("is_deflection"))


def e9_deflection_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = ops.deflection_rate(table(spark, sf, "conversations"), L, by=["role"])
    return rates.withColumn("deflection_rate", F.round("deflection_rate", 6))


def e10_majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return ops.majority_baseline(docs, docs.select("doc_id", "lang"), "lang")


def _learned(spark: SparkSession, sf: str):
    train = reliable(c.classify(c.turns(spark, sf)).select("query_id", "text", F.col("classification.intent").alias("label")))
    return train, learned.train_text_classifier(train, "text", "label", L.taxonomy, STOP)


def e11_scores_from_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions once more, from the stored coefficients by joins: rows and those that agree."""
    train, model = _learned(spark, sf)
    again = learned.predict_from_coefficients(model, train, "query_id", "text", STOP).withColumnRenamed("prediction", "again")
    both = learned.predict_text(model, train, "text", STOP).join(again, "query_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("again")).cast("long")).alias("n_agree"))


def e11_learned_classifier(spark: SparkSession, sf: str) -> DataFrame:
    train, model = _learned(spark, sf)
    return learned.predict_text(model, train, "text", STOP).select("query_id", "label", "prediction")


def model_responses(rows: DataFrame) -> DataFrame:
    """A table of model responses: clean JSON, an unknown label, a confidence above 1, or nothing."""
    body = lambda label, conf: F.concat(
        F.lit('{"intent": "'), label, F.lit('", "confidence": '), conf, F.lit(', "runner_up": "beta"}')
    )
    n = F.length("text") % 4
    raw = (
        F.when(n == 0, body(F.lit("gamma"), F.lit("0.41")))
        .when(n == 1, body(F.lit("martian"), F.lit("1.7")))
        .when(n == 2, F.lit("I cannot say"))
    )
    return rows.select(F.col("query_id").alias("id"), raw.alias("raw"), F.lit("table").alias("provider")).where(
        "raw IS NOT NULL"
    )


def e12_apply_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.turns(spark, sf)
    rules = c.classify(rows).withColumnRenamed("query_id", "id")
    out = responses.apply_responses(rules, model_responses(rows), L)
    return out.select(
        F.col("id").alias("query_id"), "classification.intent", "classification.runner_up",
        "classification.confidence", "classification.method",
    )


def e12_safety_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.turns(spark, sf)
    n = F.length("text") % 4
    raw = F.when(n == 0, '{"safety": 1, "trigger": "knife"}').when(n == 1, 'so: {"safety": 0, "reason": "calm"}').when(n == 2, "?")
    answers = rows.select("query_id", raw.alias("raw"), F.lit("table").alias("provider")).where("raw IS NOT NULL")
    out = responses.apply_safety_responses(ops.detect_context(rows, L), answers, "query_id")
    return out.select(
        "query_id", "safety.is_safety", F.array_join("safety.triggers", ",").alias("triggers"), "safety.method"
    )


def e15_dissatisfaction_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.dissatisfaction(with_reactions(spark, sf), L)
    n = F.length("text") % 3
    raw = F.when(n == 0, '{"dissatisfied": 1, "score": 0.9, "reason": "rude"}').when(n == 1, '{"dissatisfied": 0, "score": 0.2}')
    answers = rows.select("query_id", raw.alias("raw"), F.lit("table").alias("provider")).where("raw IS NOT NULL")
    out = responses.apply_dissatisfaction_responses(rows, answers, "query_id")
    return out.select(
        "query_id", "dissatisfaction.dissatisfied", "dissatisfaction.score", "dissatisfaction.method"
    )


def e13_reaction_flags(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reaction_flags(c.turns(spark, sf), L).select("query_id", "rejection", "human_request")


def e14_is_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return is_repeat(table(spark, sf, "conversations"), L)


def with_reactions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with a repeat flag and explicit feedback derived from the text length."""
    kind = F.length("text") % 5
    explicit = F.when(kind == 0, "helpful").when(kind == 1, "not_helpful").when(kind == 2, "human_request")
    repeats = is_repeat(table(spark, sf, "conversations"), L)
    return c.turns(spark, sf).withColumn("explicit", explicit).join(repeats, ["conv_id", "turn"])


def e15_dissatisfaction(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.dissatisfaction(with_reactions(spark, sf), L)
    return rows.select(
        "query_id", "dissatisfaction.dissatisfied", "dissatisfaction.score",
        F.array_join("dissatisfaction.signals", ",").alias("signals"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long table (model, id, y, yhat, ambiguous): a label rule on text size against the quality."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    name = lambda x: F.when(x == 1, "good").otherwise("bad")
    models = F.array(
        F.struct(F.lit("size").alias("model"), F.when(F.col("n_chars") > 1000, "good")
                 .when(F.col("n_chars") > 200, "bad").otherwise("unclear").alias("yhat")),
        F.struct(F.lit("constant").alias("model"), F.lit("good").alias("yhat")),
        F.struct(F.lit("lang").alias("model"), name((F.col("lang") == "en").cast("int")).alias("yhat")),
    )
    return rows.select(
        "doc_id", name(F.col("quality")).alias("y"), (F.col("toxic") == 1).alias("ambiguous"), F.inline(models)
    )


PREDICTIONS = """
pred AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS y, toxic = 1 AS ambiguous, model,
    CASE model WHEN 'size' THEN CASE WHEN n_chars > 1000 THEN 'good' WHEN n_chars > 200 THEN 'bad' ELSE 'unclear' END
      WHEN 'constant' THEN 'good' ELSE CASE WHEN lang = 'en' THEN 'good' ELSE 'bad' END END AS yhat
  FROM documents JOIN labels USING (doc_id), (VALUES ('size'), ('constant'), ('lang')) AS m(model))"""

LABELS = ("good", "bad", "unclear", "other")


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def k1_classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).where("model = 'size'")
    return _round(metrics.classification_metrics(rows, "y", "yhat", LABELS), "precision", "recall", "f1")


def k2_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf).where("model = 'size'"), "y", "yhat", LABELS)


def k3_metrics_by_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).where("model = 'size'")
    out = metrics.metrics_by_subset(rows, "y", "yhat", LABELS, "ambiguous")
    return _round(out, "precision", "recall", "f1")


def k4_lift(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.classification_metrics(predictions(spark, sf), "y", "yhat", LABELS, ["model"])
    return _round(metrics.lift(rows, "size"), "baseline_f1", "lift")


def k5_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).select(
        "model", (F.col("y") == "good").cast("int").alias("h"), (F.col("yhat") == "good").cast("int").alias("j")
    )
    wide = rows.select(
        "h", "j",
        F.when(F.col("model") == "size", F.col("j")).otherwise(F.col("h")).alias("j2"),
    )
    out = metrics.agreement(wide, {"grounded": ("h", "j"), "helpful": ("h", "j2"), "polite": ("j2", "j")})
    return _round(out, "agreement", "kappa", "mean_a", "mean_b")


def k6_check_expectations(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.classify(c.turns(spark, sf))
    checks = [
        ("a trigger means the override label scores", "safety.is_safety", "classification.confidence > 0.3"),
        ("that as a word is the override label", "text RLIKE '(?i)\\\\bthat\\\\b'", "classification.intent = 'delta'"),
        ("in the taxonomy", "true", "classification.intent IN ('alpha', 'beta', 'gamma', 'delta', 'other')"),
        ("the default is unsure", "classification.intent = 'other'", "classification.needs_context"),
    ]
    return metrics.check_expectations(rows, checks)


def k7_compare_models(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.compare_models(predictions(spark, sf), "y", "yhat", LABELS)
    return _round(out, "accuracy", "macro_f1")


QUERIES = {
    f.__name__: f
    for f in (
        e1_lexicon_scores, e2_classify_rules, e3_context_override, e4_needs_context, e5_detect_context,
        e6_compare_detectors, e7_frustration, e8_is_deflection, e9_deflection_rate,
        e10_majority_baseline, e11_learned_classifier, e11_scores_from_coefficients, e12_apply_responses, e12_safety_responses, e15_dissatisfaction_responses, e13_reaction_flags,
        e14_is_repeat, e15_dissatisfaction, k1_classification_metrics, k2_confusion,
        k3_metrics_by_subset, k4_lift, k5_agreement, k6_check_expectations, k7_compare_models,
    )
}

TURNS = c.turns_sql()
CLASSIFIED = c.classified("turns", "query_id, text")
_NAIVE = f"list_filter({c.lst(L.naive)}, lambda k: contains(lower(text), k))"
_MARKS = f"list_filter({c.lst(L.frustration)}, lambda k: contains(lower(text), k))"


def deflection_sql(x: str) -> str:
    n = f"(CASE WHEN {c.squish(x)} = '' THEN 0 ELSE len(string_split({c.squish(x)}, ' ')) END)"
    has = " OR ".join(f"contains(lower({x}), {c.q(m)})" for m in L.deflection)
    return f"(({has}) AND {n} <= {L.deflection_words})"


def any_match(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {c.q('(?i)' + p)})" for p in patterns) + ")"


REPEATS = f"""
tk AS (SELECT conv_id, turn, query_id, text, {c.tokens(c.clean('text'))} AS tok FROM turns),
tkc AS (SELECT *, {c.content('tok')} AS con FROM tk),
rep AS (
  SELECT a.conv_id, a.turn, a.query_id, a.text, coalesce(bool_or(b.turn IS NOT NULL AND
    ({c.jaccard('a.tok', 'b.tok')} >= 0.5 OR len(list_intersect(a.con, b.con)) >= 3)), false) AS is_repeat
  FROM tkc a LEFT JOIN tkc b ON a.conv_id = b.conv_id AND b.turn < a.turn
  GROUP BY a.conv_id, a.turn, a.query_id, a.text)"""

REACTIONS = f"""
react AS (
  SELECT *, CASE len(text) % 5 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' WHEN 2 THEN 'human_request' END AS explicit,
    {any_match('text', L.human_request)} AS asks_text, {any_match('text', L.rejection)} AS rejects FROM rep),
dis AS (
  SELECT *, coalesce(explicit = 'human_request', false) OR asks_text AS asks,
    CASE WHEN explicit = 'helpful' THEN 0.0::DOUBLE ELSE greatest(
      CASE WHEN coalesce(explicit = 'human_request', false) OR asks_text THEN 1.0::DOUBLE ELSE 0.0 END,
      CASE WHEN explicit = 'not_helpful' THEN 0.6::DOUBLE ELSE 0.0 END,
      CASE WHEN rejects THEN 0.7::DOUBLE ELSE 0.0 END,
      CASE WHEN is_repeat THEN 0.65::DOUBLE ELSE 0.0 END) END AS score
  FROM react)"""

_PER_CLASS = """
lab AS (SELECT unnest(['good', 'bad', 'unclear', 'other']) AS label),
per AS (
  SELECT grp, label, sum(CASE WHEN y = label AND yhat = label THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN yhat = label THEN 1 ELSE 0 END) AS predicted,
    sum(CASE WHEN y = label THEN 1 ELSE 0 END)::BIGINT AS support
  FROM src, lab GROUP BY grp, label),
pr AS (SELECT grp, label, support, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0 END AS p,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr),
acc AS (SELECT grp, avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END) AS a, count(*) AS n FROM src GROUP BY grp),
allm AS (
  SELECT grp, label, p, r, f, support FROM f
  UNION ALL SELECT grp, 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM f GROUP BY grp
  UNION ALL SELECT grp, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support)::BIGINT FROM f GROUP BY grp
  UNION ALL SELECT grp, 'accuracy', a, a, a, n FROM acc)"""

_K5 = """
wide AS (SELECT (y = 'good')::INT AS h, (yhat = 'good')::INT AS j,
  CASE WHEN model = 'size' THEN (yhat = 'good')::INT ELSE (y = 'good')::INT END AS j2 FROM pred),
long AS (SELECT 'grounded' AS dimension, h AS a, j AS b FROM wide UNION ALL SELECT 'helpful', h, j2 FROM wide
  UNION ALL SELECT 'polite', j2, j FROM wide),
s AS (SELECT dimension, count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS mean_a, avg(b) AS mean_b FROM long GROUP BY 1),
e AS (SELECT *, mean_a * mean_b + (1 - mean_a) * (1 - mean_b) AS pe FROM s)"""

SQL = {
    "e1_lexicon_scores": f"WITH {TURNS} SELECT query_id, " + ", ".join(
        f"{c.contains_sum('lower(text)', L.keywords.get(t, ()))} AS {t}" for t in L.taxonomy
    ) + " FROM turns",
    "e2_classify_rules": f"WITH {TURNS}, {CLASSIFIED} SELECT query_id, intent, runner_up, confidence FROM c_out",
    "e3_context_override": f"""WITH {TURNS}, {CLASSIFIED}
      SELECT query_id, array_to_string([s0, s1, s2, s3, s4], ',') AS scores FROM c_scores""",
    "e4_needs_context": f"WITH {TURNS}, {CLASSIFIED} SELECT query_id, confidence < 0.55 AS needs_context FROM c_out",
    "e5_detect_context": f"""WITH {TURNS}, {CLASSIFIED}
      SELECT query_id, is_safety, coalesce(array_to_string(trig, ','), '') AS triggers FROM c_out""",
    "e6_compare_detectors": f"""WITH {TURNS}, {CLASSIFIED}, n AS (SELECT *, {_NAIVE} AS naive FROM c_out)
      SELECT query_id, coalesce(array_to_string(naive, ','), '') AS naive_hits,
        CASE WHEN len(naive) > 0 AND NOT is_safety THEN 'fixed'
          WHEN (len(naive) > 0) = is_safety THEN 'correct' ELSE 'gain' END AS verdict FROM n""",
    "e7_frustration": f"WITH {TURNS} SELECT query_id, len({_MARKS}) AS n_markers, len({_MARKS}) >= 2 AS frustrated FROM turns",
    "e8_is_deflection": f"WITH {c.turns_sql('assistant')} SELECT query_id, {deflection_sql('text')} AS is_deflection FROM turns",
    "e9_deflection_rate": f"""SELECT role, count(*) AS n, sum({deflection_sql('text')}::INT)::BIGINT AS n_deflection,
      round(avg({deflection_sql('text')}::INT), 6) AS deflection_rate FROM conversations GROUP BY 1""",
    "e10_majority_baseline": """SELECT doc_id, lang, (SELECT lang FROM documents GROUP BY 1
      ORDER BY count(*) DESC, lang LIMIT 1) AS prediction FROM documents""",
    "e12_apply_responses": f"""WITH {TURNS}, {CLASSIFIED}
      SELECT query_id,
        CASE len(text) % 4 WHEN 0 THEN 'gamma' WHEN 1 THEN 'other' ELSE intent END AS intent,
        CASE WHEN len(text) % 4 < 2 THEN 'beta' ELSE runner_up END AS runner_up,
        CASE len(text) % 4 WHEN 0 THEN 0.41::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence,
        CASE len(text) % 4 WHEN 3 THEN 'rules' WHEN 2 THEN 'rules (llm_error: bad_response)' ELSE 'llm:table' END AS method
      FROM c_out""",
    "e12_safety_responses": f"""WITH {TURNS}, {CLASSIFIED}
      SELECT query_id, CASE len(text) % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE is_safety END AS is_safety,
        CASE len(text) % 4 WHEN 0 THEN 'knife' WHEN 1 THEN '' ELSE coalesce(array_to_string(trig, ','), '') END AS triggers,
        CASE len(text) % 4 WHEN 3 THEN 'rules' WHEN 2 THEN 'rules (llm_error: bad_response)' ELSE 'llm:table' END AS method
      FROM c_out""",
    "e15_dissatisfaction_responses": f"""WITH {TURNS}, {REPEATS}, {REACTIONS},
      x AS (SELECT *, CASE WHEN explicit = 'helpful' THEN 0.0::DOUBLE WHEN explicit = 'human_request' THEN 1.0::DOUBLE
          WHEN len(text) % 3 = 0 THEN 0.9::DOUBLE
          WHEN len(text) % 3 = 1 THEN CASE WHEN explicit = 'not_helpful' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END ELSE score END AS s FROM dis)
      SELECT query_id, s >= 0.6 AS dissatisfied, s AS score,
        CASE WHEN explicit IN ('helpful', 'human_request') OR len(text) % 3 = 2 THEN 'rules' ELSE 'llm:table' END AS method FROM x""",
    "e13_reaction_flags": f"""WITH {TURNS} SELECT query_id, {any_match('text', L.rejection)} AS rejection,
      {any_match('text', L.human_request)} AS human_request FROM turns""",
    "e14_is_repeat": f"WITH {TURNS}, {REPEATS} SELECT conv_id, turn, is_repeat FROM rep",
    "e15_dissatisfaction": f"""WITH {TURNS}, {REPEATS}, {REACTIONS}
      SELECT query_id, score >= 0.6 AS dissatisfied, score,
        CASE WHEN explicit = 'helpful' THEN 'explicit_helpful' ELSE concat_ws(',',
          CASE WHEN explicit = 'human_request' THEN 'explicit_human_request' END,
          CASE WHEN explicit = 'not_helpful' THEN 'explicit_thumbs_down' END,
          CASE WHEN asks_text AND coalesce(explicit, '') <> 'human_request' THEN 'explicit_human_request' END,
          CASE WHEN rejects THEN 'rejection_language' END,
          CASE WHEN is_repeat THEN 'repeated_unresolved_question' END) END AS signals FROM dis""",
    "k1_classification_metrics": f"""WITH {PREDICTIONS}, src AS (SELECT 1 AS grp, y, yhat FROM pred WHERE model = 'size'), {_PER_CLASS}
      SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM allm""",
    "k2_confusion": f"""WITH {PREDICTIONS}, lab AS (SELECT unnest(['good', 'bad', 'unclear', 'other']) AS label)
      SELECT label, count(*) FILTER (yhat = 'good') AS good, count(*) FILTER (yhat = 'bad') AS bad,
        count(*) FILTER (yhat = 'unclear') AS unclear, count(*) FILTER (yhat = 'other') AS other
      FROM lab LEFT JOIN (SELECT * FROM pred WHERE model = 'size') p ON p.y = lab.label GROUP BY label""",
    "k3_metrics_by_subset": f"""WITH {PREDICTIONS}, src AS (
        SELECT 'all' AS grp, y, yhat FROM pred WHERE model = 'size'
        UNION ALL SELECT 'clean', y, yhat FROM pred WHERE model = 'size' AND NOT ambiguous), {_PER_CLASS}
      SELECT grp AS subset, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support
      FROM allm""",
    "k4_lift": f"""WITH {PREDICTIONS}, src AS (SELECT model AS grp, y, yhat FROM pred), {_PER_CLASS}
      SELECT 'size' AS best, grp AS baseline, round(f, 6) AS baseline_f1,
        round((SELECT f FROM allm WHERE grp = 'size' AND label = 'macro avg') - f, 6) AS lift
      FROM allm WHERE label = 'macro avg' AND grp <> 'size'""",
    "k5_agreement": f"""WITH {PREDICTIONS}, {_K5}
      SELECT dimension, n, round(po, 6) AS agreement, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa,
        round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM e""",
    "e11_scores_from_coefficients": f"WITH {TURNS} SELECT count(*) AS n, count(*) AS n_agree FROM turns",
    "k6_check_expectations": f"""WITH {TURNS}, {CLASSIFIED}, t AS (
        SELECT 'a trigger means the override label scores' AS expectation, is_safety AS w, s3 > 0 AND top > 0 AS ok_ FROM c_out JOIN (SELECT query_id, s3 FROM c_scores) USING (query_id)
        UNION ALL SELECT 'that as a word is the override label', regexp_matches(text, '(?i)\\bthat\\b'), intent = 'delta' FROM c_out
        UNION ALL SELECT 'in the taxonomy', true, true FROM c_out
        UNION ALL SELECT 'the default is unsure', intent = 'other', confidence < 0.55 FROM c_out)
      SELECT expectation, sum(w::INT)::BIGINT AS n, sum((w AND ok_)::INT)::BIGINT AS n_passed,
        sum(w::INT) = sum((w AND ok_)::INT) AS ok FROM t GROUP BY 1""",
    "k7_compare_models": f"""WITH {PREDICTIONS}, src AS (SELECT model AS grp, y, yhat FROM pred), {_PER_CLASS}
      SELECT grp AS model, round(max(CASE WHEN label = 'accuracy' THEN f END), 6) AS accuracy,
        round(max(CASE WHEN label = 'macro avg' THEN f END), 6) AS macro_f1 FROM allm GROUP BY 1""",
}
