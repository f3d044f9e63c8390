"""Sources, thread reconstruction, queue and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise import schemas
from threadwise.operators import lifecycle as life
from threadwise.operators.routing import earlier_rows
from threadwise.operators import threads as ops
from threadwise.plans.registry import common as c
from threadwise.plans.registry.common import table
from threadwise.session import shared_folder
from threadwise.sources import tables as io


def a1_read_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "messages")
    io.write_dataset(c.messages(spark, sf), path, "parquet")
    return _counted(io.read_messages(spark, path, "parquet"))


def _counted(log: DataFrame) -> DataFrame:
    return log.groupBy("inbound").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("in_response_to_tweet_id").alias("n_replies"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def a1_read_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The log as quoted CSV whose texts hold line breaks and quotes."""
    path = shared_folder(spark, "csv")
    rows = c.messages(spark, sf).withColumn("text", F.concat(F.lit('"'), F.regexp_replace("text", "\\. ", ".\n"), F.lit('"')))
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select("text", "tweet_id", "author_id", "inbound", "created_at", "in_response_to_tweet_id").write.options(header=True, quoteAll=True, escape='"', **plain).csv(path)
    return _counted(io.read_messages(spark, path).withColumn("text", F.regexp_replace("text", "(?m)^\"|\"$", "")))


def a2_read_log(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "log")
    log = c.feedback(spark, sf).select(
        F.col("conversation_id").cast("string").alias("conversation_id"),
        "message_id",
        "feedback",
        F.lit("").alias("customer_query"),
        F.lit("").alias("ai_response"),
        F.lit("").alias("intent"),
        F.lit(False).alias("validated"),
        F.lit(False).alias("trusted"),
        F.col("ts").cast("string").alias("ts"),
    )
    io.append_log(log.where("feedback <> 'helpful'"), path)
    io.append_log(log.where("feedback = 'helpful'"), path)
    return (
        io.read_log(spark, path, schemas.FEEDBACK)
        .unionByName(io.read_log(spark, f"{path}-absent", schemas.FEEDBACK))
        .groupBy("conversation_id", "feedback")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested documents; a long thread comes in parts of bounded size."""
    conv = table(spark, sf, "conversations")
    message = F.struct(
        "turn",
        F.concat_ws("_", "conv_id", "turn").alias("message_id"),
        F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "ai")
        .otherwise("system").alias("role"),
        "text",
    )
    part = F.floor(F.col("turn") / 4096)
    docs = conv.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(message)).alias("m"))
    return docs.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.lit("AI_ACTIVE").alias("status"),
        F.transform(
            "m", lambda x: F.struct(x["message_id"].alias("message_id"), x["role"].alias("role"),
                                    x["text"].alias("text"))
        ).alias("messages"),
    )


def a3_read_conversations(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "documents")
    io.append_log(_documents(spark, sf), path)
    docs = io.read_conversations(spark, path, lines=True)
    return io.conversation_messages(docs).select("conversation_id", "message_id", "role", "text")


def a4_write_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "pairs")
    io.write_dataset(c.pairs(spark, sf), path, "parquet")
    return spark.read.parquet(path).select("pair_id", "customer_msg", "brand_reply")


def a5_append_log(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "appended")
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    for kind in ("click", "error", "purchase", "signup", "view"):
        io.append_log(rows.where(F.col("event_type") == kind), path)
    back = io.read_log(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


def a6_write_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "metrics")
    io.write_metrics(ops.volume_by_author(c.messages(spark, sf), 10), path)
    return spark.read.schema("author_id STRING, n_messages BIGINT").json(path)


def a7_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    updates, base = e.where("event_type <> 'view'"), e.where("event_type = 'view'")
    newest = io.upsert_latest(updates, base, "user_id", ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "value")


def b1_outbound(spark: SparkSession, sf: str) -> DataFrame:
    return ops.outbound(c.messages(spark, sf), "brand").select("tweet_id", "author_id", "text")


def b2_reply_parent_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = ops.reply_parent_join(c.messages(spark, sf), "brand")
    return joined.select("customer_tweet_id", "reply_tweet_id", "parent_inbound", "parent_text", "reply_text")


def b3_filter_pairs(spark: SparkSession, sf: str) -> DataFrame:
    joined = ops.filter_pairs(ops.reply_parent_join(c.messages(spark, sf), "brand"))
    return joined.select("customer_tweet_id", "reply_tweet_id", "customer_msg", "brand_reply")


def b4_first_reply(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reconstruct_pairs(c.messages(spark, sf), "brand").select(
        "customer_tweet_id", "customer_msg", "brand_reply"
    )


def b5_pair_id(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reconstruct_pairs(c.messages(spark, sf), "brand").select("pair_id", "customer_tweet_id")


def b6_pair_turns(spark: SparkSession, sf: str) -> DataFrame:
    return c.pairs(spark, sf)


def b7_history(spark: SparkSession, sf: str) -> DataFrame:
    """The whole history of each customer turn, one row per earlier customer turn."""
    rows = table(spark, sf, "conversations").where("role = 'user'")
    earlier = earlier_rows(rows.select("conv_id", "turn", F.col("turn").alias("at")), rows, id_="at")
    return earlier.select("conv_id", F.col("at").alias("turn"), F.col("turn").alias("earlier_turn"), "text")


def b7_last_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.with_history(table(spark, sf, "conversations"), last_n=3)
    return rows.select("conv_id", "turn", F.array_join("history", " | ").alias("history"))


def b8_depth(spark: SparkSession, sf: str) -> DataFrame:
    return ops.with_depth(table(spark, sf, "conversations")).select("conv_id", "turn", "depth")


def b9_volume_by_author(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    msgs = e.select(F.col("user_id").alias("author_id"), (F.col("event_type") == "view").alias("inbound"))
    return ops.volume_by_author(msgs, 10)


def b10_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return ops.mentions(c.messages(spark, sf), ["THAT", "from the"]).select("tweet_id", "author_id")


def j3_drop_consecutive_dups(spark: SparkSession, sf: str) -> DataFrame:
    # some messages are sent twice, and some again by another role
    conv = table(spark, sf, "conversations").withColumn("turn", F.col("turn") * 3)
    kind = F.length("text") % 3
    again = conv.where(kind == 0).withColumn("turn", F.col("turn") + 1)
    other = conv.where(kind == 1).withColumns({"turn": F.col("turn") + 2, "role": F.lit("system")})
    return life.drop_consecutive_dups(conv.unionByName(again).unionByName(other)).select("conv_id", "turn", "role", "text")


def j6_conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    first = ops.first_per(conv.where("role = 'user'"), ["conv_id"], ["turn"])
    status = (
        conv.groupBy("conv_id")
        .agg(F.when(F.count(F.lit(1)) > 4, "RESOLVED").otherwise("AI_ACTIVE").alias("status"))
        .join(c.classify(first).select("conv_id", F.col("classification.intent").alias("intent")), "conv_id", "left")
    )
    return life.conversation_summary(conv, status).withColumn("intent", F.coalesce("intent", F.lit("")))


def j7_invalid_roles(spark: SparkSession, sf: str) -> DataFrame:
    bad = life.invalid_roles(table(spark, sf, "conversations"), ["user", "assistant"])
    return bad.select("conv_id", "turn", "role", "text")


_JOINED = f"""
{c.MESSAGES},
parent AS (SELECT tweet_id, inbound, text, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY created_at, text) AS rn FROM msgs) WHERE rn = 1),
joined AS (
  SELECT r.in_response_to_tweet_id AS customer_tweet_id, r.tweet_id AS reply_tweet_id,
    p.inbound AS parent_inbound, p.text AS parent_text, r.text AS reply_text, r.created_at AS reply_at
  FROM msgs r JOIN parent p ON p.tweet_id = r.in_response_to_tweet_id
  WHERE r.author_id = 'brand' AND NOT r.inbound),
good AS (
  SELECT *, {c.squish('parent_text')} AS customer_msg, {c.squish('reply_text')} AS brand_reply
  FROM joined WHERE parent_inbound),
qual AS (SELECT * FROM good WHERE len(customer_msg) >= 5 AND len(brand_reply) >= 5),
firsts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_tweet_id ORDER BY reply_at, reply_text) AS rn FROM qual) WHERE rn = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        a1_read_messages, a1_read_csv, a2_read_log, a3_read_conversations, a4_write_dataset, a5_append_log,
        a6_write_metrics, a7_upsert_latest, b1_outbound, b2_reply_parent_join, b3_filter_pairs,
        b4_first_reply, b5_pair_id, b6_pair_turns, b7_history, b7_last_messages, b8_depth, b9_volume_by_author,
        b10_mentions, j3_drop_consecutive_dups, j6_conversation_summary, j7_invalid_roles,
    )
}

SQL = {
    "a1_read_messages": f"""WITH {c.MESSAGES}
      SELECT inbound, count(*) AS n, count(in_response_to_tweet_id) AS n_replies,
        sum(len(text))::BIGINT AS n_chars FROM msgs GROUP BY inbound""",
    "a1_read_csv": f"""WITH {c.MESSAGES}
      SELECT inbound, count(*) AS n, count(in_response_to_tweet_id) AS n_replies,
        sum(len(regexp_replace(text, '\\. ', '.' || chr(10), 'g')))::BIGINT AS n_chars FROM msgs GROUP BY inbound""",
    "a2_read_log": f"""WITH {c.FEEDBACK}
      SELECT conversation_id::VARCHAR AS conversation_id, feedback, count(*) AS n FROM fb GROUP BY 1, 2""",
    "a3_read_conversations": """
      SELECT conv_id::VARCHAR AS conversation_id,
        concat(conv_id, '_', turn) AS message_id,
        CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS role, text
      FROM conversations""",
    "a4_write_dataset": f"WITH {c.PAIRS} SELECT pair_id, customer_msg, brand_reply FROM pairs",
    "a5_append_log": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "a6_write_metrics": f"""WITH {c.MESSAGES}
      SELECT author_id, count(*) AS n_messages FROM msgs WHERE NOT inbound
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "a7_upsert_latest": """
      SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
      WHERE rn = 1""",
    "b1_outbound": f"""WITH {c.MESSAGES}
      SELECT tweet_id, author_id, text FROM msgs WHERE author_id = 'brand' AND NOT inbound""",
    "b2_reply_parent_join": f"""WITH {_JOINED}
      SELECT customer_tweet_id, reply_tweet_id, parent_inbound, parent_text, reply_text FROM joined""",
    "b3_filter_pairs": f"""WITH {_JOINED}
      SELECT customer_tweet_id, reply_tweet_id, customer_msg, brand_reply FROM qual""",
    "b4_first_reply": f"WITH {_JOINED} SELECT customer_tweet_id, customer_msg, brand_reply FROM firsts",
    "b5_pair_id": f"""WITH {_JOINED}
      SELECT concat('uc_', customer_tweet_id) AS pair_id, customer_tweet_id FROM firsts""",
    "b6_pair_turns": f"WITH {c.PAIRS} SELECT pair_id, conv_id, turn, customer_msg, brand_reply FROM pairs",
    "b7_history": """
      SELECT a.conv_id, a.turn, b.turn AS earlier_turn, b.text FROM conversations a JOIN conversations b
      ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'user' AND b.role = 'user'""",
    "b7_last_messages": """
      SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS history
      FROM conversations WHERE role = 'user'""",
    "b8_depth": """
      SELECT conv_id, turn, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth
      FROM conversations""",
    "b9_volume_by_author": """
      SELECT user_id AS author_id, count(*) AS n_messages FROM events WHERE event_type <> 'view'
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "b10_mentions": f"""WITH {c.MESSAGES}
      SELECT tweet_id, author_id FROM msgs
      WHERE inbound AND (contains(lower(text), 'that') OR contains(lower(text), 'from the'))""",
    "j3_drop_consecutive_dups": """
      WITH m AS (SELECT conv_id, turn * 3 AS turn, role, text FROM conversations
        UNION ALL SELECT conv_id, turn * 3 + 1, role, text FROM conversations WHERE len(text) % 3 = 0
        UNION ALL SELECT conv_id, turn * 3 + 2, 'system', text FROM conversations WHERE len(text) % 3 = 1),
      n AS (SELECT *, lag(role) OVER w = role AND lag(text) OVER w = text AS same FROM m
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, role, text FROM n WHERE NOT coalesce(same, false)""",
    "j6_conversation_summary": f"""WITH
      firsts AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
      {c.classified('firsts', 'conv_id, text')},
      st AS (SELECT conv_id, CASE WHEN count(*) > 4 THEN 'RESOLVED' ELSE 'AI_ACTIVE' END AS status
             FROM conversations GROUP BY 1)
      SELECT st.conv_id, status, coalesce(intent, '') AS intent,
        coalesce(substr(text, 1, 60), '(no message)') AS first_text
      FROM st LEFT JOIN c_out USING (conv_id)""",
    "j7_invalid_roles": """
      SELECT conv_id, turn, role, text FROM conversations WHERE role NOT IN ('user', 'assistant')""",
}
