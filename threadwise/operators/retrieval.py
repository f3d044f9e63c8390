"""Lexical retrieval: TF-IDF, exact cosine top-k, verified memory, layer merge and its metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed
from threadwise.config import Settings
from threadwise.functions import text as X
from threadwise.operators.impact import top_postings
from threadwise.session import reliable


@dataclass(frozen=True)
class TfidfModel:
    """A fitted space. ``vocab`` (term, term_id, df, idf) has at most ``max_features`` rows, which is
    what makes broadcasting it safe at any corpus size."""

    vocab: DataFrame
    n_docs: int
    stop: tuple[str, ...]
    abbreviations: Mapping[str, str] = field(default_factory=lambda: dict(fixed.ABBREVIATIONS))
    settings: Settings = Settings()

    def with_terms(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add the terms of a raw text."""
        cleaned = X.clean_text(F.col(text), abbreviations=self.abbreviations)
        return with_terms(df.withColumn("_clean", cleaned), "_clean", out, self.stop).drop("_clean")


def with_terms(df: DataFrame, cleaned: str, out: str, stop: Sequence[str]) -> DataFrame:
    """Add words of two or more characters without stop words, and the pairs of neighbours left.

    Each step is a column of its own: it is read several times below and must not be repeated.
    """
    found = F.regexp_extract_all(F.lower(cleaned), F.lit(f"([{X.WORD}]{{2,}})"), F.lit(1))
    df = df.withColumn("_found", found)
    kept = F.filter("_found", lambda t: ~t.isin(list(stop))) if stop else F.col("_found")
    df = df.withColumn("_kept", kept)
    left = F.greatest(F.size("_kept") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("_kept", 1, left),
        F.slice("_kept", 2, left),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return df.withColumn(out, F.concat("_kept", pairs)).drop("_found", "_kept")


def _counts(df: DataFrame, key: str, text: str, model: TfidfModel, extra: Sequence[str]) -> DataFrame:
    """(key, extra, term, tf). The texts are shuffled once by key; counting then needs no shuffle.

    The number of partitions is stated because what follows is many times larger than the texts,
    which is what adaptive coalescing would go by.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(key, *extra, F.col(text).alias("_text")).repartition(parts, key)
    placed = model.with_terms(placed, "_text", "_terms")
    # A plain explode would infer a filter on the array and cut every text a second time below it.
    exploded = placed.select(key, *extra, F.explode_outer("_terms").alias("term"))
    return exploded.where("term IS NOT NULL").groupBy(key, *extra, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(
    corpus: DataFrame,
    key: str,
    text: str,
    stop: Sequence[str] = (),
    abbreviations: Mapping[str, str] = fixed.ABBREVIATIONS,
    settings: Settings = Settings(),
) -> TfidfModel:
    """Terms in at least ``min_df`` texts; the ``max_features`` most frequent, ties by term;
    idf = ln((1 + n) / (1 + df)) + 1. The vocabulary is written to the shared folder."""
    blank = TfidfModel(corpus.limit(0), 0, tuple(stop), dict(abbreviations), settings)
    n_docs = corpus.count()
    seen = _counts(corpus, key, text, blank, ())
    totals = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = (
        totals.where(F.col("df") >= settings.min_df)
        .orderBy(F.desc("cf"), "term")
        .limit(settings.max_features)
    )
    # one window over at most max_features rows
    numbered = kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocab = reliable(numbered.select("term", "term_id", "df", "cf", idf.alias("idf")))
    return TfidfModel(vocab, n_docs, tuple(stop), dict(abbreviations), settings)


def transform_tfidf(
    model: TfidfModel, df: DataFrame, key: str, text: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Postings (key, extra, term_id, weight) in the fitted space, unit length per key.

    The result is partitioned by ``key``: the vocabulary is broadcast and the norm runs over one
    text's terms, so the texts themselves are all that is shuffled.
    """
    counted = _counts(df, key, text, model, extra)
    vocab = F.broadcast(model.vocab.select("term", "term_id", "idf"))
    weighed = counted.join(vocab, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighed.select(key, *extra, "term_id", (F.col("_w") / norm).alias("weight"))


def best_k(scored: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Rank by score, ties by document id. The limit runs before the shuffle as well, so each input
    partition sends at most k rows per query."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_pairs(
    queries: DataFrame,
    corpus: DataFrame,
    query: str,
    doc: str,
    same: Sequence[str] = (),
    settings: Settings = Settings(),
    at_least: float = 0.0,
) -> DataFrame:
    """Cosine of every (query, document) that share a term, from postings of unit vectors.

    ``same`` lists columns that must agree; a null on the query side agrees with everything.
    With ``at_least`` only pairs that can reach it are scored: a query's terms from the rarest on up to
    where the norm of the rest falls below it (``reaching``) must meet one of the document's, since
    without them the product cannot exceed that norm.
    Queries of up to ``broadcast_bytes`` stay beside the corpus partitions: products are summed per
    document where it lies and no pair is shuffled. Beyond the bound the postings meet on the term,
    where adaptive execution splits frequent terms.
    """
    queries = reliable(queries)
    corpus = reliable(corpus) if at_least > 0 else corpus  # read three times below
    ours = queries.select(
        query, F.col("term_id").alias("_t"), F.col("weight").alias("_qw"),
        *[F.col(c).alias(f"_same_{c}") for c in same],
    )
    if at_least > 0:
        first = reaching(queries, corpus, query, at_least).select(
            query, F.col("term_id").alias("_t"), *[F.col(c).alias(f"_same_{c}") for c in same]
        )
        met = _agreeing(corpus.join(first, F.col("term_id") == F.col("_t")), same)
        pairs = reliable(met.select(doc, query).distinct())
        products = corpus.select(doc, "term_id", "weight").join(pairs, doc).join(
            queries.select(query, "term_id", F.col("weight").alias("_qw")), [query, "term_id"]
        )
    else:
        size = queries.agg(F.sum(F.octet_length(F.col(query).cast("string")) + 32).alias("n")).head()
        if (size.n or 0) <= settings.broadcast_bytes:
            ours = F.broadcast(ours)
        products = _agreeing(corpus.join(ours, F.col("term_id") == F.col("_t")), same)
    return products.groupBy(doc, query).agg(
        F.round(F.sum(F.col("weight") * F.col("_qw")), 4).alias("score")
    )


def _agreeing(met: DataFrame, same: Sequence[str]) -> DataFrame:
    for c in same:
        met = met.where(F.col(f"_same_{c}").isNull() | (F.col(f"_same_{c}") == F.col(c)))
    return met


def reaching(queries: DataFrame, corpus: DataFrame, query: str, at_least: float) -> DataFrame:
    """The postings of each query that a document must meet to reach ``at_least``: its rarest terms.
    The bound is lowered by the rounding of scores. There is one row per term in the frequencies."""
    met = corpus.groupBy("term_id").agg(F.count(F.lit(1)).alias("_met"))
    order = Window.partitionBy(query).orderBy(F.coalesce("_met", F.lit(0)), "term_id")
    rest = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = queries.join(met, "term_id", "left").withColumn("_rest", F.sqrt(rest))
    return ranked.where((F.col("_rest") >= at_least - 1e-4) & F.col("_met").isNotNull()).drop("_rest", "_met")


def topk_lexical(
    model: TfidfModel,
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    query: str = "query_id",
    doc: str = "pair_id",
    query_text: str = "text",
    doc_text: str = "customer_msg",
    pad: bool = False,
    query_postings: DataFrame | None = None,
) -> DataFrame:
    """The k most similar documents per query as (query, doc, score, rank, method).

    ``query_postings`` are those of ``transform_tfidf`` if they are there already. Documents that share no term score 0. ``pad`` fills a query's list up to k with the first of
    them by id, so every query gets k hits, as a full ranking would give.
    """
    posts = transform_tfidf(model, queries, query, query_text) if query_postings is None else query_postings
    scored = top_postings(posts, transform_tfidf(model, corpus, doc, doc_text), k, query, doc, settings=model.settings)
    hits = best_k(scored, query, doc, k)
    if pad:
        hits = pad_hits(hits, queries.select(query), corpus.select(doc), k, query, doc)
    return hits.select(query, doc, "score", "rank", F.lit("tfidf").alias("method"))


def pad_hits(
    hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, query: str, doc: str
) -> DataFrame:
    """Fill lists shorter than k with zero-score documents in id order.

    A short list holds fewer than k documents, so the first 2k ids always contain enough others.
    """
    first = corpus.orderBy(doc).limit(2 * k).agg(F.sort_array(F.collect_list(doc)))
    hit = F.struct(F.col("rank"), F.col(doc), F.col("score"))
    got = hits.groupBy(query).agg(F.sort_array(F.collect_list(hit)).alias("_hits"))  # at most k
    rows = queries.distinct().join(got, query, "left").withColumn("_first", first.scalar())
    none = F.array().cast(got.schema["_hits"].dataType)
    rows = rows.withColumn("_hits", F.coalesce("_hits", none))
    others = F.filter("_first", lambda d: ~F.exists("_hits", lambda h: h[doc] == d))
    more = F.transform(
        F.slice(others, 1, k - F.size("_hits")),
        lambda d, i: F.struct(
            (F.size("_hits") + i + 1).alias("rank"), d.alias(doc), F.lit(0.0).alias("score")
        ),
    )
    full = rows.select(query, F.inline(F.concat("_hits", more.cast(got.schema["_hits"].dataType))))
    return full.select(query, doc, "score", "rank")


def attach_texts(hits: DataFrame, corpus: DataFrame, doc: str = "pair_id") -> DataFrame:
    """Give each hit its texts, source ``historical`` and ``verified`` false. Only hits are joined,
    so the wide texts never take part in scoring."""
    texts = corpus.select(doc, "customer_msg", "brand_reply")
    return hits.join(texts, doc).withColumns(
        {"source": F.lit("historical"), "verified": F.lit(False)}
    )


def retrieve_verified(
    model: TfidfModel,
    queries: DataFrame,
    memory: DataFrame,
    k: int = 3,
    query: str = "query_id",
    query_text: str = "text",
    intent: str | None = "intent",
    query_postings: DataFrame | None = None,
) -> DataFrame:
    """Top-k human-verified resolutions per query: verified, same intent, similar enough.

    ``query_postings`` are those of ``transform_tfidf`` with the intent if they are there already. A document is the resolution's query and answer together, weighed in the corpus' space.
    """
    docs = memory.where(F.col("human_verified").eqNullSafe(F.lit(True))).withColumn(
        "_doc", F.concat_ws(" ", "original_query", "human_resolution")
    )
    same = (intent,) if intent else ()
    scored = top_postings(
        transform_tfidf(model, queries, query, query_text, same) if query_postings is None else query_postings,
        transform_tfidf(model, docs, "resolution_id", "_doc", same),
        k, query, "resolution_id", same, model.settings, model.settings.resolution_similarity,
    ).where(F.col("score") >= model.settings.resolution_similarity)
    hits = best_k(scored, query, "resolution_id", k)
    told = docs.select(
        "resolution_id",
        F.col("original_query").alias("customer_msg"),
        F.col("human_resolution").alias("brand_reply"),
        F.col("intent").alias("memory_intent"),
        "conflict_flag",
    )
    return hits.join(told, "resolution_id").select(
        query,
        F.concat(F.lit("res_"), "resolution_id").alias("pair_id"),
        "customer_msg",
        "brand_reply",
        "score",
        "rank",
        F.lit("resolution_memory").alias("method"),
        F.lit("human_resolution").alias("source"),
        F.lit(True).alias("verified"),
        "memory_intent",
        "conflict_flag",
    )


def merge_layers(
    historical: DataFrame,
    verified: DataFrame,
    k: int = 3,
    query: str = "query_id",
    settings: Settings = Settings(),
    historical_score: str = "score",
) -> DataFrame:
    """Best k of both layers, verified hits lifted by a small boost.

    A query with no verified hit keeps its historical order untouched. ``historical_score`` may
    name a plain cosine, so that both layers are merged on one scale.
    """
    cols = [query, "pair_id", "customer_msg", "brand_reply", "score", "rank", "method", "source", "verified"]
    lifted = F.round(F.col("score") + settings.verified_boost, 4)
    ours = verified.withColumn("score", lifted).select(*cols, F.lit(0).alias("_layer"))
    theirs = historical.withColumn("score", F.col(historical_score))
    both = ours.unionByName(theirs.select(*cols, F.lit(1).alias("_layer")))
    # at most 2k rows per query from here on
    either = Window.partitionBy(query)
    both = both.withColumn("_any", F.min("_layer").over(either) == 0)
    order = either.orderBy(F.when(F.col("_any"), -F.col("score")), "_layer", "rank", "pair_id")
    return (
        both.withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= k)
        .withColumn("rank", F.col("_at"))
        .drop("_at", "_any", "_layer")
    )


def minmax_scale(df: DataFrame, by: str, score: str, out: str) -> DataFrame:
    """Scale to [0, 1] among the rows of one query; all equal gives 0.

    The bounds are a pre-aggregated ``groupBy`` joined back, so a query's rows are never gathered.
    """
    bounds = df.groupBy(by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return (
        df.join(bounds, by)
        .withColumn(out, F.when(span > 0, (F.col(score) - F.col("_low")) / span).otherwise(0.0))
        .drop("_low", "_high")
    )


def topk_auto(**backends: DataFrame | None) -> tuple[str, DataFrame]:
    """The best backend that is available: dense vectors, then hybrid, then LSA, then TF-IDF.

    Returns its name and its hits; ``method`` in the hits says what ran.
    """
    for name in ("dense", "hybrid", "lsa", "tfidf"):
        if backends.get(name) is not None:
            return name, backends[name]
    raise ValueError("no retrieval backend given")


def retrieval_metrics(
    hits: DataFrame, truth: DataFrame, k: int = 3, query: str = "query_id", by: Sequence[str] = ()
) -> DataFrame:
    """intent-match@k (some hit of the first k has the query's true label) and mean top-1 score.

    ``hits`` carries ``hit_label``, ``truth`` carries ``true_label``; queries with no hit count 0.
    """
    labelled = hits.where(F.col("rank") <= k).join(truth, query)
    found = labelled.groupBy(query, *by).agg(
        F.max((F.col("hit_label") == F.col("true_label")).cast("int")).alias("_match"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_top"),
    )
    n = truth.agg(F.count(F.lit(1))).scalar()
    return found.groupBy(*by).agg(
        F.max(n).alias("n_queries"),
        (F.sum("_match") / F.max(n)).alias(f"intent_match_at_{k}"),
        (F.sum("_top") / F.max(n)).alias("mean_top1"),
    )


def memory_metrics(hits: DataFrame, expected: DataFrame, query: str = "query_id") -> DataFrame:
    """Memory checks per kind of expected query.

    ``expected`` holds query and ``kind``: ``recontact`` should find a verified resolution (and rank
    it first); ``below_threshold`` and ``intent_mismatch`` should find none.
    """
    verified = F.coalesce(F.col("source") == "human_resolution", F.lit(False))
    per_query = (
        expected.join(hits, query, "left")
        .groupBy(query, "kind")
        .agg(
            F.max(verified.cast("int")).alias("_found"),
            F.max((verified & (F.col("rank") == 1)).cast("int")).alias("_first"),
        )
    )
    return per_query.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_found").alias("found_rate"),
        F.avg("_first").alias("verified_first_rate"),
        (1 - F.avg("_found")).alias("excluded_rate"),
    )
