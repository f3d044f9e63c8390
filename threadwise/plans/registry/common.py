"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.lexicon import Lexicon
from threadwise.operators.classify import classify_rules
from threadwise.operators.threads import first_per, pair_turns
from threadwise.plans.fixture import FIXTURE, STOP_WORDS

L = FIXTURE
STOP = STOP_WORDS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- SQL building blocks

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
WORD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    inner = ", ".join(q(v) for v in values)
    return f"CAST([{inner}] AS VARCHAR[])"


def squish(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(SPACE)}, ' ', 'g'))"


def collapse(x: str) -> str:
    """Runs of three or more of one character keep one. RE2 has no back-references, so the
    characters are listed, nine to a pass."""
    chars = [chr(i) for i in range(32, 127)] + list("àâäáæçéèêëíìîïñóòôöœßúùûüÿÀÂÄÉÈÊÍÎÏÑÓÔÖÚÛÜ—–…·•★█\t")
    for at in range(0, len(chars), 9):
        part = [c if c.isalnum() else "\\" + c if ord(c) < 127 and c != "\t" else c for c in chars[at : at + 9]]
        pattern = "|".join(f"({c}){c}{{2,}}" for c in part)
        x = f"regexp_replace({x}, {q(pattern)}, '{''.join(chr(92) + str(i + 1) for i in range(len(part)))}', 'g')"
    return x


def expand(x: str, abbreviations) -> str:
    for short, full in abbreviations.items():
        if short != full:
            pattern = q(f"(^|[^{WORD}]){short}($|[^{WORD}])")
            for _ in range(2):  # neighbours share a separator
                x = f"regexp_replace({x}, {pattern}, {q(chr(92) + '1' + full + chr(92) + '2')}, 'g')"
    return x


def clean(x: str, repeats: bool = True) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {q(r'https?://[^ \t\n\r]+|t\.co/[^ \t\n\r]+|www\.[^ \t\n\r]+')}, ' URL ', 'g')"
    t = f"regexp_replace({t}, {q(f'@[{WORD}]+')}, ' ', 'g')"
    if repeats:
        t = collapse(t)
    t = expand(f"lower({t})", L.abbreviations)
    keep = f"[^{WORD}\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}'#$/.,!?%-]"
    return squish(f"regexp_replace({t}, {q(keep)}, ' ', 'g')")


def tokens(cleaned: str) -> str:
    return f"list_distinct(list_filter(string_split({cleaned}, ' '), lambda t: t <> ''))"


def content(tok: str, stop=STOP) -> str:
    return f"list_filter({tok}, lambda t: len(t) >= 3 AND NOT list_contains({lst(stop)}, t))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    either = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {either} > 0 THEN {both}::DOUBLE / {either} ELSE 0.0 END"


def two(x: str) -> str:
    """Two digits, rounded half up on the decimal text."""
    return f"printf('%.2f', CAST(round(CAST({x} AS DECIMAL(8,3)), 2) AS DOUBLE))"


# ---------------------------------------------------------------- context detector in SQL


def fires(lex: Lexicon = L) -> str:
    """Whether word ``t`` triggers, given ``near`` (4 words either side) and ``before`` (3 words)."""
    before = "list_transform(coalesce(before, CAST([] AS VARCHAR[])), lambda z: replace(z, '''', ''))"
    tests = [f"t IN ({', '.join(q(w) for w in lex.strong)})"]
    for term, (wanted, unwanted) in lex.ambiguous.items():
        cond = f"t = {q(term)}"
        if unwanted:
            cond += f" AND NOT list_has_any(near, {lst(unwanted)})"
        if wanted:
            cond += f" AND list_has_any(near, {lst(wanted)})"
        tests.append(f"({cond})")
    return f"({' OR '.join(tests)}) AND NOT list_has_any({before}, {lst(lex.negations)})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z'']+')"


def contains_sum(low: str, needles) -> str:
    return " + ".join([f"(CASE WHEN contains({low}, {q(n)}) THEN 1 ELSE 0 END)" for n in needles]) or "0"


def classified(source: str, key: str, text: str = "text", lex: Lexicon = L) -> str:
    """CTEs ``c_words``, ``c_scores``, ``c_out`` (key columns, intent, confidence, runner_up, triggers)."""
    k = len(lex.taxonomy)
    raw = []
    for i, label in enumerate(lex.taxonomy):
        score = contains_sum("low", lex.keywords.get(label, ()))
        if label == lex.override_label:
            score = f"(CASE WHEN len(trig) > 0 THEN {score} + 3 ELSE 0 END)"
        raw.append(f"({score}) AS s{i}")
    ranks = ", ".join(f"s{i} * 100 + {k - 1 - i}" for i in range(k))
    total = " + ".join(f"s{i}" for i in range(k))
    names = lst(lex.taxonomy)
    terms = ", ".join(q(t) for t in (*lex.strong, *lex.ambiguous))
    return f"""
c_words AS (SELECT {key}, lower(coalesce({text}, '')) AS low, {words(text)} AS w,
              row_number() OVER () AS c_id FROM {source}),
c_tok AS (SELECT c_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM c_words),
c_win AS (SELECT c_id, t,
            list(t) OVER (PARTITION BY c_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near,
            list(t) OVER (PARTITION BY c_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before
          FROM c_tok),
c_hit AS (SELECT c_id, list_sort(list(DISTINCT t)) AS trig FROM c_win
          WHERE t IN ({terms}) AND {fires(lex)} GROUP BY c_id),
c_trig AS (SELECT {key}, low, coalesce(trig, CAST([] AS VARCHAR[])) AS trig
           FROM c_words LEFT JOIN c_hit USING (c_id)),
c_scores AS (SELECT {key}, low, trig, {', '.join(raw)} FROM c_trig),
c_rank AS (SELECT *, list_reverse_sort([{ranks}]) AS r, {total} AS total FROM c_scores),
c_out AS (
  SELECT {key}, low, trig, total,
    r[1] // 100 AS top,
    CASE WHEN r[1] // 100 = 0 THEN {q(lex.default_label)} ELSE {names}[{k} - r[1] % 100] END AS intent,
    {names}[{k} - r[2] % 100] AS runner_up,
    CASE WHEN r[1] // 100 = 0 THEN 0.3::DOUBLE
      ELSE round(least(0.95::DOUBLE, 0.45::DOUBLE + 0.5::DOUBLE * ((r[1] // 100)::DOUBLE / total)), 3) END AS confidence,
    len(trig) > 0 AS is_safety
  FROM c_rank)"""


# ---------------------------------------------------------------- derived inputs


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """A message log made of the turns: every turn answers the one before it, every third turn the
    one before that."""
    c = table(spark, sf, "conversations")
    tid = F.col("conv_id") * 1000 + F.col("turn")
    back = F.when(F.col("turn") % 3 == 0, 2).otherwise(1)
    return c.select(
        tid.alias("tweet_id"),
        F.when(F.col("role") == "assistant", "brand")
        .when(F.col("role") == "system", "desk")
        .otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
        .alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
        "text",
        F.when(F.col("turn") > 0, tid - back).alias("in_response_to_tweet_id"),
    )


MESSAGES = """
msgs AS (
  SELECT conv_id * 1000 + turn AS tweet_id,
    CASE role WHEN 'assistant' THEN 'brand' WHEN 'system' THEN 'desk'
      ELSE concat('c', conv_id) END AS author_id,
    role = 'user' AS inbound, conv_id * 100 + turn AS created_at, text,
    CASE WHEN turn > 0 THEN conv_id * 1000 + turn - (CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END) END
      AS in_response_to_tweet_id
  FROM conversations)"""


def turns(spark: SparkSession, sf: str, role: str = "user") -> DataFrame:
    """Messages of one role with an id."""
    c = table(spark, sf, "conversations").where(F.col("role") == role)
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"),
        "conv_id",
        "turn",
        "text",
    )


def turns_sql(role: str = "user", name: str = "turns") -> str:
    return (
        f"{name} AS (SELECT concat(conv_id, '_', turn) AS query_id, conv_id, turn, text "
        f"FROM conversations WHERE role = {q(role)})"
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pair_turns(table(spark, sf, "conversations"))


PAIRS = f"""
near AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT concat('uc_', conv_id, '_', turn) AS pair_id, conv_id, turn,
            {squish('text')} AS customer_msg, {squish('next_text')} AS brand_reply
          FROM near WHERE role = 'user' AND next_role = 'assistant')"""


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    return classify_rules(df, L, text, keep_safety="safety")


FEEDBACK_KIND = {"purchase": "helpful", "error": "not_helpful", "signup": "human_request"}


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback clicks made of events: user = conversation, the number in props = message."""
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in FEEDBACK_KIND.items() for x in kv])
    return e.where(F.col("event_type").isin(list(FEEDBACK_KIND))).select(
        "event_id",
        "ts",
        F.col("user_id").alias("conversation_id"),
        F.get_json_object("props", "$.k").alias("message_id"),
        F.try_element_at(kind, F.col("event_type")).alias("feedback"),
    )


FEEDBACK = """
fb AS (
  SELECT event_id, ts, user_id AS conversation_id, json_extract_string(props, '$.k') AS message_id,
    CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'not_helpful'
      WHEN 'signup' THEN 'human_request' END AS feedback
  FROM events WHERE event_type IN ('purchase', 'error', 'signup'))"""


def lifecycle(df: DataFrame) -> DataFrame:
    """Lifecycle events made of events: user = conversation."""
    kind = F.col("event_type")
    return df.select(
        F.col("user_id").alias("conv_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), "message")
        .when(kind == "error", "escalate")
        .when(kind == "purchase", "resolve")
        .otherwise("close")
        .alias("kind"),
        F.when(kind == "view", "customer").when(kind == "click", "human").alias("role"),
        F.lit(None).cast("string").alias("status"),
    )


# One step per event and conversation: the recursion follows the order of a user's events.
LIFECYCLE = """
ev AS (SELECT user_id AS conv_id, event_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk(conv_id, rn, before, after, rejected, reopened) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'AI_ACTIVE', 'AI_ACTIVE', 0, 0 FROM ev
  UNION ALL
  SELECT e.conv_id, e.rn, w.after,
    CASE e.event_type
      WHEN 'view' THEN CASE WHEN w.after IN ('RESOLVED', 'CLOSED') THEN 'WAITING_FOR_HUMAN' ELSE w.after END
      WHEN 'error' THEN 'WAITING_FOR_HUMAN'
      WHEN 'click' THEN CASE WHEN w.after = 'WAITING_FOR_HUMAN' THEN 'HUMAN_ACTIVE' ELSE w.after END
      WHEN 'purchase' THEN CASE WHEN w.after = 'CLOSED' THEN 'CLOSED' ELSE 'RESOLVED' END
      ELSE 'CLOSED' END,
    CASE WHEN e.event_type = 'purchase' AND w.after = 'CLOSED' THEN 1 ELSE 0 END,
    CASE WHEN e.event_type = 'view' AND w.after IN ('RESOLVED', 'CLOSED') THEN 1 ELSE 0 END
  FROM walk w JOIN ev e ON e.conv_id = w.conv_id AND e.rn = w.rn + 1)"""

STATUS = """
last AS (SELECT conv_id, max(rn) AS n_events, sum(rejected)::BIGINT AS n_rejected,
           sum(reopened)::BIGINT AS n_reopened, max_by(after, rn) AS status FROM walk GROUP BY conv_id)"""


def resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """One verified resolution per conversation: first question, first answer, and the question's
    intent."""
    c = table(spark, sf, "conversations")
    first = first_per(c.where("role IN ('user', 'assistant')"), ["conv_id", "role"], ["turn"])
    both = first.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("original_query"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("human_resolution"),
    )
    both = both.where("original_query IS NOT NULL AND human_resolution IS NOT NULL")
    rows = classify(both, "original_query")
    return rows.select(
        F.format_string("r%d", "conv_id").alias("resolution_id"),
        F.col("conv_id").alias("seq"),
        "original_query",
        "human_resolution",
        F.col("classification.intent").alias("intent"),
        F.lit(True).alias("human_verified"),
        F.lit(False).alias("conflict_flag"),
    )


RESOLUTIONS = f"""
asked AS (SELECT conv_id, min_by(text, turn) AS original_query FROM conversations WHERE role = 'user' GROUP BY 1),
told AS (SELECT conv_id, min_by(text, turn) AS human_resolution FROM conversations WHERE role = 'assistant' GROUP BY 1),
both_ AS (SELECT conv_id, original_query, human_resolution FROM asked JOIN told USING (conv_id)),
{classified('both_', 'conv_id, original_query, human_resolution', 'original_query').replace('c_', 'm_')},
memory AS (SELECT concat('r', conv_id) AS resolution_id, conv_id AS seq, original_query, human_resolution, intent FROM m_out)"""
