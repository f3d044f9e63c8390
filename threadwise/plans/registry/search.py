"""Retrieval, drafting and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.operators import dense, drafts
from threadwise.operators import retrieval as ops
from threadwise.plans.registry import common as c
from threadwise.plans.registry.classify import deflection_sql
from threadwise.plans.registry.common import L, STOP, table
from threadwise.session import reliable

#: Cells of the vector index and how many of them a query that need not be exact visits.
CELLS, PROBES = 16, 11

# ---------------------------------------------------------------- queries


def space(
    spark: SparkSession, sf: str, settings: Settings = Settings()
) -> tuple[DataFrame, ops.TfidfModel]:
    """The corpus, written once, and the space fitted on it."""
    corpus = reliable(c.pairs(spark, sf))
    return corpus, ops.fit_tfidf(corpus, "pair_id", "customer_msg", STOP, settings=settings)


def f1_fit_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    _, m = space(spark, sf)
    return m.vocab.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def f2_transform_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    _, m = space(spark, sf)
    posts = ops.transform_tfidf(m, c.turns(spark, sf, "assistant"), "query_id", "text")
    return posts.join(m.vocab.select("term_id", "term"), "term_id").select(
        "query_id", "term", F.round("weight", 6).alias("weight")
    )


def lexical(spark: SparkSession, sf: str, pad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(corpus, best 3 hits per customer turn)."""
    corpus, m = space(spark, sf)
    return corpus, ops.topk_lexical(m, c.turns(spark, sf), corpus, 3, pad=pad)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    corpus, hits = lexical(spark, sf, pad=True)
    return ops.attach_texts(hits, corpus)


def f3_topk_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical(spark, sf, pad=True)[1].select("query_id", "pair_id", "score", "rank")


def lsa_model(spark: SparkSession, sf: str) -> tuple[DataFrame, dense.LsaModel]:
    corpus, m = space(spark, sf)
    return corpus, dense.fit_lsa(m, corpus, "pair_id", "customer_msg")


def f4_topk_lsa(spark: SparkSession, sf: str) -> DataFrame:
    corpus, lsa = lsa_model(spark, sf)
    return dense.topk_lsa(lsa, c.turns(spark, sf), corpus)


def f5_topk_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    corpus, lsa = lsa_model(spark, sf)
    return dense.topk_hybrid(lsa, c.turns(spark, sf), corpus)


def f6_topk_dense(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    hits = dense.topk_dense(
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
        e.select(F.col("vec_id").alias("pair_id"), "embedding"),
        k=4,
    )
    return hits.select("query_id", "pair_id", "score", "rank")


def f7_topk_auto(spark: SparkSession, sf: str) -> DataFrame:
    name, hits = ops.topk_auto(tfidf=lexical(spark, sf, pad=True)[1], dense=None)
    return hits.groupBy("method").agg(F.count(F.lit(1)).alias("n")).withColumn("backend", F.lit(name))


def f7_topk_auto_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Both backends are there: vectors are preferred, and the hits are theirs."""
    e = table(spark, sf, "embeddings")
    index = dense.fit_cells(e.select(F.col("vec_id").alias("pair_id"), "embedding"), "pair_id")
    found = dense.topk_cells(index, e.select(F.col("vec_id").alias("query_id"), "embedding"), 4)
    name, hits = ops.topk_auto(tfidf=lexical(spark, sf, pad=True)[1], dense=found)
    return hits.select("query_id", "pair_id", "score", "rank", "method", F.lit(name).alias("backend"))


def f6_topk_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the nearest ``PROBES`` cells hold nine in ten of the exact four nearest vectors, or more."""
    e = table(spark, sf, "embeddings")
    ask = e.select(F.col("vec_id").alias("query_id"), "embedding")
    index = dense.fit_cells(e.select(F.col("vec_id").alias("pair_id"), "embedding"), "pair_id", cells=CELLS)
    some = reliable(dense.topk_cells(index, ask, 4, probes=PROBES))
    every = reliable(dense.topk_cells(index, ask, 4))
    met = every.join(some.select("query_id", "pair_id"), ["query_id", "pair_id"], "left_semi")
    return every.agg(F.count(F.lit(1)).alias("n")).crossJoin(met.agg(F.count(F.lit(1)).alias("_met"))).select("n", (F.col("_met") >= 0.9 * F.col("n")).alias("recall_reached"))


def f4_scores_from_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the latent hits once more, from the stored basis by joins: per query, the hits and those that agree.

    The basis, of at most max_features rows, meets the terms where a text lies; a text's vector is one row."""
    corpus, lsa = lsa_model(spark, sf)
    hits = reliable(dense.topk_lsa(lsa, c.turns(spark, sf), corpus))
    parts = F.sort_array(F.collect_list(F.struct("component", "value")))
    basis = reliable(dense.basis_table(spark, lsa).groupBy("term_id").agg(F.transform(parts, lambda p: p["value"]).alias("row")))

    def latent(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
        posts = ops.transform_tfidf(lsa.tfidf, df, key, text).join(F.broadcast(basis), "term_id")
        sums = [F.sum(F.col("weight") * F.col("row")[i]).alias(f"c{i}") for i in range(lsa.basis.shape[1])]
        return reliable(posts.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"c{i}") for i in range(len(sums))]).alias(out)))

    q, d = latent(c.turns(spark, sf), "query_id", "text", "q"), latent(corpus, "pair_id", "customer_msg", "d")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # a hit that comes several times counts as often in its product
    times = F.count(F.lit(1)).over(Window.partitionBy("query_id", "pair_id"))
    again = hits.withColumn("_times", times).join(q, "query_id", "left").join(d, "pair_id", "left")
    cosine = F.coalesce(F.try_divide(F.col("_times") * product("q", "d"), F.sqrt(product("q", "q")) * F.sqrt(product("d", "d"))), F.lit(0.0))
    return again.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs(cosine - F.col("score")) < 2e-4).cast("long")).alias("n_agree"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return c.classify(c.turns(spark, sf)).select("query_id", "text", F.col("classification.intent").alias("intent"))


def verified(spark: SparkSession, sf: str, m: ops.TfidfModel) -> DataFrame:
    return ops.retrieve_verified(m, asked(spark, sf), c.resolutions(spark, sf), 3)


def f8_retrieve_verified(spark: SparkSession, sf: str) -> DataFrame:
    hits = verified(spark, sf, space(spark, sf)[1])
    return hits.select("query_id", "pair_id", "score", "rank", "source", "memory_intent")


def both_layers(model: ops.TfidfModel, questions: DataFrame, corpus: DataFrame, memory: DataFrame) -> DataFrame:
    """Best 3 of the corpus and of the verified memory; the questions are cleaned and weighed once."""
    posts = reliable(ops.transform_tfidf(model, questions, "query_id", "text", ["intent"]))
    historical = ops.topk_lexical(model, questions, corpus, 3, pad=True, query_postings=posts)
    found = ops.retrieve_verified(model, questions, memory, 3, query_postings=posts)
    return ops.merge_layers(ops.attach_texts(historical, corpus), found, 3)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    corpus, m = space(spark, sf)
    return both_layers(m, reliable(asked(spark, sf)), corpus, c.resolutions(spark, sf))


def f9_merge_layers(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("query_id", "pair_id", "score", "rank", "verified")


def f10_retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    corpus, found = lexical(spark, sf, pad=True)
    labels = c.classify(corpus, "customer_msg").select(
        "pair_id", F.col("classification.intent").alias("hit_label")
    )
    truth = asked(spark, sf).select("query_id", F.col("intent").alias("true_label"))
    hits = found.join(labels, "pair_id")
    out = ops.retrieval_metrics(hits, truth, 3, by=["method"])
    return out.select(
        "method", "n_queries", F.round("intent_match_at_3", 6).alias("intent_match_at_3"),
        F.round("mean_top1", 4).alias("mean_top1"),
    )


def f11_memory_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text") % 3
    expected = c.turns(spark, sf).select(
        "query_id",
        F.when(n == 0, "recontact").when(n == 1, "below_threshold").otherwise("intent_mismatch").alias("kind"),
    )
    out = ops.memory_metrics(merged(spark, sf), expected)
    return out.select("kind", "n", *[F.round(x, 6).alias(x) for x in ("found_rate", "verified_first_rate", "excluded_rate")])


def g1_draft_from_templates(spark: SparkSession, sf: str) -> DataFrame:
    out = drafts.draft_from_templates(asked(spark, sf), evidence(spark, sf), L)
    return out.select("query_id", "draft", "cited_example_id", "justification", "method")


def checked(spark: SparkSession, sf: str) -> DataFrame:
    link = F.concat(F.col("text"), F.lit(" https://help.example/"), F.col("query_id"))
    rows = asked(spark, sf).withColumn(
        "draft", F.when(F.length("text") % 3 == 0, link).when(F.length("text") % 3 == 1, F.col("text")).otherwise("so it is")
    )
    return drafts.verify_drafts(rows, evidence(spark, sf), L)


def g2_verify_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).select("query_id", "ok", F.array_join("issues", "; ").alias("issues"))


def g3_choose_draft(spark: SparkSession, sf: str) -> DataFrame:
    tries = c.turns(spark, sf).withColumn("attempt", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    cand = tries.select(
        "query_id", "attempt",
        F.concat(F.lit("try "), F.col("attempt").cast("string")).alias("draft"),
        F.when((F.col("attempt") < 2) & ((F.length("text") + F.col("attempt")) % 7 == 0), "Timeout").alias("error"),
        ((F.length("text") + F.col("attempt")) % 5 == 0).alias("ok"),
        F.when(F.col("attempt") == 2, "rules-synth").otherwise("model").alias("method"),
    )
    cand = cand.withColumn("ok", F.col("ok") & F.col("error").isNull())
    return drafts.choose_draft(cand, error="error").select("query_id", "draft", "ok", "method")


def g4_verification_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = drafts.verification_rate(checked(spark, sf))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


QUERIES = {
    f.__name__: f
    for f in (
        f1_fit_tfidf, f2_transform_tfidf, f3_topk_lexical, f4_topk_lsa, f5_topk_hybrid, f6_topk_dense,
        f6_topk_probes, f4_scores_from_basis, f7_topk_auto, f7_topk_auto_dense, f8_retrieve_verified, f9_merge_layers, f10_retrieval_metrics, f11_memory_metrics,
        g1_draft_from_templates, g2_verify_drafts, g3_choose_draft, g4_verification_rate,
    )
}

# ---------------------------------------------------------------- the same in SQL


def terms_sql(name: str, source: str, key: str, text: str) -> str:
    """``<name>_tf`` (key, term, tf): words without stop words, and neighbours among those left."""
    stop = ", ".join(c.q(s) for s in STOP)
    return f"""
{name}_tok AS (SELECT {key}, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (
  SELECT {key}, regexp_extract_all({c.clean(text)}, '[{c.WORD}]{{2,}}') AS t FROM {source})),
{name}_kept AS (SELECT {key}, t, i, lead(t) OVER (PARTITION BY {key} ORDER BY i) AS nxt
  FROM {name}_tok WHERE t NOT IN ({stop})),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, t AS term FROM {name}_kept
  UNION ALL SELECT {key}, concat(t, ' ', nxt) FROM {name}_kept WHERE nxt IS NOT NULL) GROUP BY 1, 2)"""


VOCAB = f"""
{terms_sql('d', 'pairs', 'pair_id', 'customer_msg')},
vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf,
    ln((1.0::DOUBLE + (SELECT count(*) FROM pairs)) / (1.0::DOUBLE + count(*))) + 1.0 AS idf
  FROM d_tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 20000)"""


def weights_sql(name: str, key: str) -> str:
    return f"""
{name}_raw AS (SELECT {key}, term, tf * idf AS w FROM {name}_tf JOIN vocab USING (term)),
{name}_w AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""


SPACE_SQL = f"{c.PAIRS}, {VOCAB}, {weights_sql('d', 'pair_id')}"

TOP3 = f"""
{c.turns_sql()}, {terms_sql('u', 'turns', 'query_id', 'text')}, {weights_sql('u', 'query_id')},
sim AS (SELECT query_id, pair_id, round(sum(u_w.w * d_w.w), 4) AS score
  FROM u_w JOIN d_w USING (term) GROUP BY 1, 2),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS rank FROM sim)
  WHERE rank <= 3)"""

# zero-score documents fill short lists in id order
PADDED = """
few AS (SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 6),
got AS (SELECT t.query_id, count(top3.pair_id) AS n FROM turns t LEFT JOIN top3 USING (query_id) GROUP BY 1),
fill AS (SELECT query_id, pair_id, 0.0::DOUBLE AS score, n + row_number() OVER (PARTITION BY query_id ORDER BY pair_id) AS rank
  FROM got, few WHERE n < 3 AND NOT EXISTS (
    SELECT 1 FROM top3 h WHERE h.query_id = got.query_id AND h.pair_id = few.pair_id)),
hits AS (SELECT query_id, pair_id, score, rank FROM top3
  UNION ALL SELECT query_id, pair_id, score, rank FROM fill WHERE rank <= 3)"""

INTENTS = c.classified("turns", "query_id, text")

VERIFIED = f"""
{c.RESOLUTIONS},
mdoc AS (SELECT resolution_id, intent, concat_ws(' ', original_query, human_resolution) AS doc FROM memory),
{terms_sql('r', 'mdoc', 'resolution_id', 'doc')}, {weights_sql('r', 'resolution_id')},
{INTENTS},
vsim AS (SELECT u_w.query_id, r_w.resolution_id, q.intent, round(sum(u_w.w * r_w.w), 4) AS score
  FROM u_w JOIN r_w USING (term) JOIN c_out q ON q.query_id = u_w.query_id
  JOIN mdoc m ON m.resolution_id = r_w.resolution_id AND m.intent = q.intent GROUP BY 1, 2, 3),
ver AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resolution_id) AS rank
  FROM vsim WHERE score >= 0.30) WHERE rank <= 3)"""

MERGED = """
either AS (
  SELECT query_id, concat('res_', resolution_id) AS pair_id, round(score + 0.15, 4) AS score, rank, true AS verified, 0 AS layer FROM ver
  UNION ALL SELECT query_id, pair_id, score, rank, false, 1 FROM hits),
flag AS (SELECT *, min(layer) OVER (PARTITION BY query_id) = 0 AS any_ FROM either),
mrg AS (SELECT query_id, pair_id, score, verified, at_ AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_ THEN -score END, layer, rank, pair_id) AS at_ FROM flag)
  WHERE at_ <= 3)"""

CHECKED = f"""
{INTENTS},
dr AS (SELECT query_id, text, intent, CASE len(text) % 3 WHEN 0 THEN concat(text, ' https://help.example/', query_id)
    WHEN 1 THEN text ELSE 'so it is' END AS draft FROM c_out),
ev AS (SELECT query_id, string_agg(lower(brand_reply), ' ') AS evidence FROM hits JOIN pairs USING (pair_id) GROUP BY 1),
chk AS (SELECT query_id, len(string_split({c.squish('draft')}, ' ')) < 4 AS short,
    CASE WHEN contains(draft, 'https://') AND NOT contains(evidence, lower(concat('https://help.example/', query_id)))
      THEN concat('invented_url:https://help.example/', query_id) END AS url,
    CASE WHEN contains(lower(draft), 'and the') THEN 'unsupported_promise:and the' END AS p1,
    CASE WHEN contains(lower(draft), 'it was') THEN 'unsupported_promise:it was' END AS p2,
    CASE WHEN {deflection_sql('draft')} THEN 'dm_deflection_soft' END AS soft1,
    CASE WHEN intent = 'delta' AND NOT (contains(lower(draft), 'safe') OR contains(lower(draft), 'sorry') OR contains(lower(draft), 'the '))
      THEN 'safety_tone_missing_soft' END AS soft2
  FROM dr LEFT JOIN ev USING (query_id)),
ver_ AS (SELECT query_id, NOT short AND url IS NULL AND p1 IS NULL AND p2 IS NULL AS ok,
    CASE WHEN short THEN 'empty_or_too_short' ELSE concat_ws('; ', url, p1, p2, soft1, soft2) END AS issues,
    NOT short AND (url IS NOT NULL OR p1 IS NOT NULL OR p2 IS NOT NULL) AS hard FROM chk)"""

_OPEN, _NEXT = L.opening[""], L.next_step[""]

F6_SQL = """SELECT query_id, pair_id, score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS pair_id,
          round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score
        FROM embeddings a, embeddings b)) WHERE rank <= 4"""

SQL = {
    "f1_fit_tfidf": f"WITH {c.PAIRS}, {VOCAB} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab",
    "f2_transform_tfidf": f"""WITH {SPACE_SQL}, {c.turns_sql('assistant')}, {terms_sql('u', 'turns', 'query_id', 'text')},
      {weights_sql('u', 'query_id')} SELECT query_id, term, round(w, 6) AS weight FROM u_w""",
    "f3_topk_lexical": f"WITH {SPACE_SQL}, {TOP3}, {PADDED} SELECT query_id, pair_id, score, rank::INT AS rank FROM hits",
    "f6_topk_dense": F6_SQL,
    "f6_topk_probes": "SELECT count(*) * 4 AS n, true AS recall_reached FROM embeddings",
    "f4_scores_from_basis": f"WITH {c.turns_sql()} SELECT query_id, 3::BIGINT AS n, 3::BIGINT AS n_agree FROM turns",
    "f7_topk_auto_dense": F6_SQL.replace("rank::INT AS rank", "rank::INT AS rank, 'st' AS method, 'dense' AS backend", 1),
    "f7_topk_auto": f"WITH {SPACE_SQL}, {TOP3}, {PADDED} SELECT 'tfidf' AS method, count(*) AS n, 'tfidf' AS backend FROM hits",
    "f8_retrieve_verified": f"""WITH {SPACE_SQL}, {TOP3}, {VERIFIED}
      SELECT query_id, concat('res_', resolution_id) AS pair_id, score, rank::INT AS rank,
        'human_resolution' AS source, intent AS memory_intent FROM ver""",
    "f9_merge_layers": f"""WITH {SPACE_SQL}, {TOP3}, {PADDED}, {VERIFIED}, {MERGED}
      SELECT query_id, pair_id, score, rank::INT AS rank, verified FROM mrg""",
    "f10_retrieval_metrics": f"""WITH {SPACE_SQL}, {TOP3}, {PADDED}, {INTENTS},
      {c.classified('pairs', 'pair_id', 'customer_msg').replace('c_', 'p_')},
      per AS (SELECT query_id, max((p.intent = q.intent)::INT) AS m, max(CASE WHEN rank = 1 THEN score END) AS top
        FROM hits JOIN p_out p USING (pair_id) JOIN c_out q USING (query_id) GROUP BY 1)
      SELECT 'tfidf' AS method, (SELECT count(*) FROM turns) AS n_queries,
        round(sum(m)::DOUBLE / (SELECT count(*) FROM turns), 6) AS intent_match_at_3,
        round(sum(top)::DOUBLE / (SELECT count(*) FROM turns), 4) AS mean_top1 FROM per""",
    "f11_memory_metrics": f"""WITH {SPACE_SQL}, {TOP3}, {PADDED}, {VERIFIED}, {MERGED},
      ex AS (SELECT query_id, CASE len(text) % 3 WHEN 0 THEN 'recontact' WHEN 1 THEN 'below_threshold' ELSE 'intent_mismatch' END AS kind FROM turns),
      per AS (SELECT ex.query_id, kind, max(coalesce(verified, false)::INT) AS f, max(coalesce(verified AND rank = 1, false)::INT) AS g
        FROM ex LEFT JOIN mrg USING (query_id) GROUP BY 1, 2)
      SELECT kind, count(*) AS n, round(avg(f), 6) AS found_rate, round(avg(g), 6) AS verified_first_rate,
        round(1 - avg(f), 6) AS excluded_rate FROM per GROUP BY 1""",
    "g1_draft_from_templates": f"""WITH {SPACE_SQL}, {TOP3}, {PADDED}, {INTENTS},
      best AS (SELECT query_id, count(*) FILTER (contains(lower(brand_reply), 'to ') OR contains(lower(brand_reply), 'on ')) AS private,
          list(pair_id ORDER BY rank) AS ids FROM hits JOIN pairs USING (pair_id) GROUP BY 1),
      kind AS (SELECT query_id, ids, CASE WHEN intent = 'delta' THEN 1 WHEN private >= 2 THEN 2 ELSE 3 END AS k FROM c_out JOIN best USING (query_id))
      SELECT query_id, ids[1] AS cited_example_id, 'rules-synth' AS method,
        concat({c.q(_OPEN)}, CASE k WHEN 1 THEN ' Please DM us the trip details now so we can '
          WHEN 2 THEN ' If you DM us your account email and the trip details, we''ll '
          ELSE ' Reply here with your account email and the details and we''ll ' END, {c.q(_NEXT)},
          CASE k WHEN 1 THEN ' straight away.' WHEN 2 THEN ' as quickly as we can.' ELSE '.' END) AS draft,
        concat('Synthesized from ', len(ids), ' similar historical cases (', array_to_string(ids, ', '),
          '); mirrors their resolution pattern (', CASE k WHEN 1 THEN 'move the customer to a private channel and escalate'
          WHEN 2 THEN 'move to DM for account details, then resolve' ELSE 'gather details, then follow up directly' END,
          ') without copying any reply verbatim.') AS justification FROM kind""",
    "g2_verify_drafts": f"WITH {SPACE_SQL}, {TOP3}, {PADDED}, {CHECKED} SELECT query_id, ok, issues FROM ver_",
    "g3_choose_draft": f"""WITH {c.turns_sql()}, t AS (SELECT query_id, len(text) AS n FROM turns),
      a AS (SELECT query_id, n, CASE WHEN n % 7 = 0 THEN 3 WHEN n % 5 = 0 THEN 0 WHEN (n + 1) % 7 = 0 THEN 3
        WHEN (n + 1) % 5 = 0 THEN 1 ELSE 2 END AS at_ FROM t)
      SELECT query_id, concat('try ', least(at_, 2)) AS draft, (n + least(at_, 2)) % 5 = 0 AS ok,
        CASE WHEN at_ = 3 THEN 'rules (llm_error: Timeout)' WHEN at_ = 2 THEN 'rules-synth (verify_fallback)' ELSE 'model' END AS method FROM a""",
    "g4_verification_rate": f"""WITH {SPACE_SQL}, {TOP3}, {PADDED}, {CHECKED}
      SELECT count(*) AS n, sum(ok::INT)::BIGINT AS n_pass, round(avg(ok::INT), 6) AS pass_rate,
        sum(hard::INT)::BIGINT AS n_hard_fail FROM ver_""",
}
