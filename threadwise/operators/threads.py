"""Thread reconstruction: message/reply pairs, history and contact depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.functions.text import squish, text_or_empty
from threadwise.operators.ordered import CUT_ROWS, int_chunk, with_neighbour, with_running, with_tail
from threadwise.session import reliable


def outbound(msgs: DataFrame, brand: str) -> DataFrame:
    """Replies written by one brand."""
    return msgs.where((F.col("author_id") == brand) & ~F.col("inbound"))


def inbound(msgs: DataFrame) -> DataFrame:
    return msgs.where(F.col("inbound"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key. The rank filter runs before the shuffle too (``WindowGroupLimit``), so a
    key with many copies sends one row per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")



#: A parent with more replies than this is copied, one copy to so many replies.
HOT_REPLIES = 100_000


def _dealt(replies: DataFrame, parents: DataFrame, key: str, unique: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``, by which they join too: replies of hot parents are dealt over parts of about
    ``rows`` rows, and a parent is copied to each of its parts. Counts of replies are pre-aggregated; there is one
    row per hot parent, and without any nothing is joined."""
    counts = replies.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = reliable(counts.where(F.col("_n") > rows).select(key, F.ceil(F.col("_n") / rows).cast("int").alias("_parts")))
    n = hot.count()
    if not n:
        return replies.withColumn("_part", F.lit(0)), parents.withColumn("_part", F.lit(0))
    hot = F.broadcast(hot) if n <= CUT_ROWS else hot
    parts = F.coalesce("_parts", F.lit(1))
    dealt = replies.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(unique), parts).cast("int")).drop("_parts")
    copied = parents.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, copied


def reply_parent_join(
    msgs: DataFrame, brand: str, order: Sequence[str] = ("created_at", "text"), hot_replies: int = HOT_REPLIES
) -> DataFrame:
    """Every reply of the brand with the message it answers.

    Replies whose parent is null or unknown drop out; a repeated parent id means its first row.
    """
    replies = outbound(msgs, brand).where("in_response_to_tweet_id IS NOT NULL")
    replies = replies.select(
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("reply_tweet_id"),
        F.col("text").alias("reply_text"),
        *[F.col(c).alias(f"_reply_{c}") for c in order],
    )
    parents = first_per(msgs.where("tweet_id IS NOT NULL"), ["tweet_id"], order).select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("inbound").alias("parent_inbound"),
        F.col("text").alias("parent_text"),
        F.col("created_at"),
    )
    replies, parents = _dealt(replies, parents, "customer_tweet_id", "reply_tweet_id", hot_replies)
    return replies.join(parents, ["customer_tweet_id", "_part"]).drop("_part")


def filter_pairs(joined: DataFrame, min_len: int = 5) -> DataFrame:
    """Keep replies to real customer messages where both cleaned texts are long enough."""
    return (
        joined.where("parent_inbound")
        .withColumn("customer_msg", squish(F.col("parent_text")))
        .withColumn("brand_reply", squish(F.col("reply_text")))
        .where((F.length("customer_msg") >= min_len) & (F.length("brand_reply") >= min_len))
    )


def first_reply(pairs: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first qualifying reply per customer message; filter before calling."""
    return first_per(pairs, ["customer_tweet_id"], order)


def pair_id(c: Column, prefix: str = "uc_") -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def reconstruct_pairs(
    msgs: DataFrame,
    brand: str,
    order: Sequence[str] = ("created_at", "text"),
    min_len: int = 5,
    prefix: str = "uc_",
) -> DataFrame:
    """Message log to (customer message, brand reply) pairs.

    Whether a reply qualifies depends on the reply alone, and whether a parent qualifies is the same
    for all its replies. So the first long enough reply per parent is taken *before* the join: the
    join is one to one, and a parent with very many replies stays one row.
    """
    replies = (
        outbound(msgs, brand)
        .where("in_response_to_tweet_id IS NOT NULL")
        .withColumn("brand_reply", squish(F.col("text")))
        .where(F.length("brand_reply") >= min_len)
    )
    replies = first_per(replies, ["in_response_to_tweet_id"], order).select(
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"), "brand_reply"
    )
    parents = (
        first_per(msgs.where("tweet_id IS NOT NULL"), ["tweet_id"], order)
        .where("inbound")
        .select(
            F.col("tweet_id").alias("customer_tweet_id"),
            squish(F.col("text")).alias("customer_msg"),
            "created_at",
        )
        .where(F.length("customer_msg") >= min_len)
    )
    return parents.join(replies, "customer_tweet_id").select(
        pair_id(F.col("customer_tweet_id"), prefix).alias("pair_id"),
        "customer_tweet_id",
        "customer_msg",
        "brand_reply",
        "created_at",
    )


def pair_turns(
    conv: DataFrame,
    from_role: str = "user",
    to_role: str = "assistant",
    key: str = "conv_id",
    order: str = "turn",
    prefix: str = "uc_",
) -> DataFrame:
    """Pairs of neighbouring turns, for logs that number turns and keep no parent id."""
    rows = conv.select(key, order, "role", "text")
    near = with_neighbour(rows, [key], [order], int_chunk(order), ["role", "text"], "_next", step=1)
    return near.where((F.col("role") == from_role) & (F.col("_next.role") == to_role)).select(
        F.concat(
            F.lit(prefix), F.col(key).cast("string"), F.lit("_"), F.col(order).cast("string")
        ).alias("pair_id"),
        key,
        order,
        squish(F.col("text")).alias("customer_msg"),
        squish(F.col("_next.text")).alias("brand_reply"),
    )


def with_depth(
    conv: DataFrame,
    role: str = "user",
    key: str = "conv_id",
    order: str = "turn",
    out: str = "depth",
) -> DataFrame:
    """Number of earlier messages of ``role`` before each row, in threads of any length."""
    counted = {out: (F.col("role") == role).cast("long")}
    return with_running(conv, [key], [order], int_chunk(order), counted, inclusive=False)


def with_history(
    conv: DataFrame,
    last_n: int,
    role: str = "user",
    key: str = "conv_id",
    order: str = "turn",
    out: str = "history",
) -> DataFrame:
    """Each message of ``role`` with the texts of its last ``last_n`` predecessors, oldest first.

    An array of *all* predecessors would grow with the square of the thread, so the size is asked
    for. Consumers that need every predecessor have their own exact operators (``with_depth``,
    ``is_repeat``, ``history_rows``).
    """
    rows = conv.where(F.col("role") == role).withColumn("text", text_or_empty(F.col("text")))
    return with_tail(rows, [key], [order], int_chunk(order), "text", last_n, out)


def volume_by_author(msgs: DataFrame, n: int = 10, author: str = "author_id") -> DataFrame:
    """The n busiest outbound authors; ties by name."""
    counts = msgs.where(~F.col("inbound")).groupBy(author).agg(F.count(F.lit(1)).alias("n_messages"))
    return counts.orderBy(F.desc("n_messages"), author).limit(n)


def mentions(msgs: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Inbound messages that mention any pattern, ignoring case; null text is no mention."""
    found = text_or_empty(F.col(text)).rlike("(?iu)" + "|".join(patterns))
    return inbound(msgs).where(found)
