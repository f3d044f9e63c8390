import random

import pytest
from pyspark.sql import functions as F

from threadwise import Settings, support_lexicon
from threadwise.operators import classify as C
from threadwise.operators import responses
from threadwise.operators.repeats import candidate_pairs, is_repeat
from threadwise.operators.routing import escalate, route

LEX = support_lexicon()


@pytest.fixture(scope="module")
def rows(spark):
    texts = [
        "the app keeps crashing every time I book",
        "my driver crashed the car into a wall",
        "there was no accident, the app just froze",
        "driver was soooo reckless and dangerous, i feared for my life",
        "UNSAFE DRIVER!!! he was drunk",
        "",
        "charged twice pls refund",
        "the driver didn't harass me",
        "my friend was rear-ended in an accident",
        "asdkjh qwe zxcv",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r for r in C.classify_rules(df, LEX, keep_safety="safety").collect()}


def test_context_decides_safety(rows):
    fired = {i for i, r in rows.items() if r.safety.is_safety}
    assert fired == {1, 3, 4, 8}
    assert rows[1].safety.triggers == ["crashed"]
    assert rows[4].safety.triggers == ["drunk", "unsafe"]
    assert "tech context: app, keeps" in rows[0].safety.reason
    assert "'accident' ignored" in rows[2].safety.reason
    assert "'harass' ignored (negated)" in rows[7].safety.reason


def test_rules(rows):
    c = rows[6].classification
    assert (c.intent, c.runner_up, c.confidence, c.method, c.needs_context) == ("billing_payment", "account_access", 0.95, "rules", False)
    assert c.reason == "matched billing_payment keyword(s): 'charge', 'charged', 'refund'"
    for i in (5, 9, 10):
        c = rows[i].classification
        assert (c.intent, c.confidence, c.runner_up, c.needs_context) == ("general_query", 0.3, "account_access", True)
    assert rows[1].classification.intent == "safety_incident"
    assert rows[0].classification.intent != "safety_incident"


def test_brand_adds_its_food_keywords():
    assert "acmeeats" in support_lexicon("Acme").keywords["delivery_order"]
    assert "acmeeats" not in LEX.keywords["delivery_order"]


def test_low_confidence_by_spread(spark):
    text = "refund password pickup food worst how do i"
    r = C.classify_rules(spark.createDataFrame([(text,)], "text string"), LEX).first().classification
    assert r.intent == "billing_payment" and r.confidence == round(0.45 + 0.5 / 6, 3) and r.needs_context


def test_classifier_plan_has_no_python(spark):
    plan = C.classify_rules(spark.createDataFrame([("a",)], "text string"), LEX)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_routing_reasons(spark):
    df = spark.createDataFrame(
        [("charged twice pls refund", 0), ("worst and useless, refund me", 0), ("refund", 3)], "text string, depth int"
    )
    out = [r.routing for r in route(C.classify_rules(df, LEX, keep_safety="safety"), LEX).collect()]
    assert out[0].decision == "AI" and "confident (0.95)" in out[0].reason
    assert out[1].decision == "HUMAN" and "high frustration (2 markers: worst, useless)" in out[1].reason
    assert out[2].reason == "Routed to HUMAN because: repeat contact (3 prior messages in thread)."


def test_dissatisfaction(spark):
    df = spark.createDataFrame(
        [
            ("that's wrong", None, False), ("that's wrong", "helpful", True), ("fine", "not_helpful", False),
            ("let me talk to a human", "human_request", False), ("again", None, True), ("the app keeps crashing", None, False),
        ],
        "text string, explicit string, is_repeat boolean",
    )
    got = [(r.dissatisfaction.dissatisfied, r.dissatisfaction.score, r.dissatisfaction.signals) for r in C.dissatisfaction(df, LEX).collect()]
    assert got == [
        (True, 0.7, ["rejection_language"]), (False, 0.0, ["explicit_helpful"]), (True, 0.6, ["explicit_thumbs_down"]),
        (True, 1.0, ["explicit_human_request"]), (True, 0.65, ["repeated_unresolved_question"]), (False, 0.0, []),
    ]


def test_escalation_needs_context_for_dissatisfaction(spark):
    base = [
        ("that's wrong, refund", 0, None, 0, None, None, False), ("that's wrong, refund", 1, None, 0, None, None, False),
        ("refund", 0, "not_helpful", 2, 0.05, False, True), ("refund please talk to an agent", 0, None, 0, 0.1, True, False),
    ]
    df = spark.createDataFrame(
        base, "text string, depth int, explicit string, thumbs_down_count int, top_score double, verification_ok boolean, generation_failed boolean"
    ).withColumn("is_repeat", F.lit(False))
    got = [r.escalation for r in escalate(C.classify_rules(df, LEX, keep_safety="safety"), LEX).collect()]
    assert got[0].route == "AI" and got[1].signals == ["high_dissatisfaction"] and got[1].confidence == 0.65
    assert got[2].signals == ["second_thumbs_down", "low_retrieval_confidence", "groundedness_failure", "llm_failure"]
    assert got[2].confidence == 1.0
    assert got[3].signals == ["explicit_human_request"]
    assert got[3].reason == "Escalated because the customer explicitly requested a human agent."


def test_responses(spark):
    rules = C.classify_rules(spark.createDataFrame([(i, "refund") for i in range(7)], "id long, text string"), LEX)
    raw = [
        (0, '{"intent": "trip_issue", "confidence": 0.4, "runner_up": "nope", "reason": " r "}'),
        (1, '```json\n{"intent": "trip_issue", "confidence": 1.7}\n```'),
        (2, 'I think {sic} this: {"intent": "martian", "confidence": "0.5"} ok'),
        (3, "no json here"), (4, '{"intent": "trip_issue", "confidence": "high"}'), (5, "[1, 2]"),
    ]
    table = spark.createDataFrame(raw, "id long, raw string").withColumn("provider", F.lit("p"))
    got = {r.id: r.classification for r in responses.apply_responses(rules, table, LEX).collect()}
    assert (got[0].intent, got[0].confidence, got[0].runner_up, got[0].needs_context, got[0].reason) == ("trip_issue", 0.4, "general_query", True, "r")
    assert (got[1].confidence, got[1].method, got[1].reason) == (1.0, "llm:p", "model classified this as trip_issue")
    assert (got[2].intent, got[2].confidence) == ("general_query", 0.5)
    for i in (3, 4, 5):
        assert (got[i].intent, got[i].method) == ("billing_payment", "rules (llm_error: bad_response)")
    assert got[6].method == "rules"


def brute_repeat(rows, stop):
    out = {}
    for conv, turn, text in rows:
        tok = set(text.split())
        con = {t for t in tok if len(t) >= 3 and t not in stop}
        hit = False
        for c2, t2, x2 in rows:
            if c2 == conv and t2 < turn:
                tok2 = set(x2.split())
                con2 = {t for t in tok2 if len(t) >= 3 and t not in stop}
                union = tok | tok2
                hit |= (len(tok & tok2) / len(union) if union else 0) >= 0.5 or len(con & con2) >= 3
        out[conv, turn] = hit
    return out


def test_repeats_in_long_threads_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["refund", "card", "trip", "late", "the", "you", "my", "is", "ab", "cd", "app", "broken", "again", "order"] + [f"word{i}" for i in range(120)]
    rows = []
    for conv, n in ((1, 70), (2, 25), (3, 3), (4, 1)):
        for turn in range(n):
            text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 7)))
            rows.append((conv, turn, rows[-1][2] if rng.random() < 0.05 and rows else text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    want = brute_repeat(rows, LEX.content_stop)
    for near in (4, 16, 64):
        got = {(r.conv_id, r.turn): r.is_repeat for r in is_repeat(df, LEX, near_rows=near).collect()}
        assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_sets_of_a_hot_thread_meet_by_rare_words_only(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(["please", "help", *rng.sample(words, 8)]) for _ in range(200)]  # a third of all rows
    texts += [texts[i] + " now" for i in range(0, 100, 10)]
    rows = [(0, i, t) for i, t in enumerate(texts)] + [(1 + i % 100, i // 100, f"other {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = {(r.conv_id, r.turn): r.is_repeat for r in is_repeat(df, LEX, near_rows=16).collect()}
    assert got == brute_repeat(rows, LEX.content_stop)
    assert all(got[0, 200 + i] for i in range(10))
    sets = df.where("conv_id = 0").select("conv_id", "turn", F.split("text", " ").alias("tok"), F.split("text", " ").alias("con"))
    pairs = candidate_pairs(sets, "conv_id", "turn", Settings()).count()
    assert pairs < 0.2 * len(texts) ** 2 / 2  # all of them share two words
