from pyspark.sql import functions as F

from threadwise.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_squish_and_norm_key(spark):
    assert one(spark, X.squish(F.col("t")), t="  a \t b\n ") == "a b"
    assert one(spark, X.squish(F.lit(None))) == ""
    assert one(spark, X.norm_key(F.col("t")), t=" Über  A ") == "über a"


def test_clean_text(spark):
    assert (
        one(spark, X.clean_text(F.col("t")), t="@Some_Brand the app keeps CRASHINGGGG!! https://t.co/x pls help")
        == "the app keeps crashing!! url please help"
    )
    assert one(spark, X.clean_text(F.col("t")), t="I was chargedddd twice, refnd plz") == "i was charged twice, refund please"
    assert one(spark, X.clean_text(F.col("t")), t="u u ur 1000 ünü ☃ñ") == "you you your 10 ünü ñ"
    assert one(spark, X.clean_text(F.col("t"), letters_only=True), t="1000 hellooo") == "1000 hello"
    assert one(spark, X.clean_text(F.col("t"), drop_handles=False), t="@me hi") == "me hi"


def test_collapse_needs_three(spark):
    assert one(spark, X.collapse_repeats(F.col("t")), t="aab bbb cccc\n\n\n") == "aab b c\n\n\n"


def test_words_and_counts(spark):
    assert one(spark, X.words(F.col("t")), t="It's A rear-ended car2") == ["it's", "a", "rear", "ended", "car"]
    assert one(spark, X.word_count(F.col("t")), t="  ") == 0
    assert one(spark, X.word_count(F.col("t")), t=" a  b ") == 2


def test_jaccard_edges(spark):
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a="", b="  ") == 0.0
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a="a b", b="b a") == 1.0


def test_shared_content_drops_short_and_stop(spark):
    assert one(spark, X.shared_content(F.col("a"), F.col("b"), ["the"]), a="the app is slow", b="the app is so slow") == ["app", "slow"]


def test_content_id_ignores_case_and_spacing(spark):
    a = one(spark, X.content_id(F.lit(" Hello  World"), F.lit("OK")))
    b = one(spark, X.content_id(F.lit("hello world"), F.lit(" ok ")))
    assert a == b and len(a) == 16
    assert a != one(spark, X.content_id(F.lit("hello"), F.lit("world ok")))


def test_urls_and_preview(spark):
    assert one(spark, X.urls(F.col("t")), t="see https://a.b/c and t.co/x now") == ["https://a.b/c", "t.co/x"]
    assert one(spark, X.preview(F.col("t"), 5), t="a|bcdefg") == "a/bcd"


def test_matches_any_is_case_blind_and_null_safe(spark):
    assert one(spark, X.matches_any(F.col("t"), ["real (person|human)"]), t="A REAL Human") is True
    assert one(spark, X.matches_any(F.lit(None), ["x"])) is False
    assert one(spark, X.matches_any(F.lit("x"), [])) is False
