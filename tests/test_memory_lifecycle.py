import random
from collections import Counter
from dataclasses import replace
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed
from threadwise.config import Settings
from threadwise.operators import alike
from threadwise.operators import lifecycle as L
from threadwise.operators import memory as M
from threadwise.operators import routing
from threadwise.operators.ordered import int_chunk


def records(spark, rows):
    return spark.createDataFrame(rows, "seq long, original_query string, human_resolution string, intent string, human_verified boolean")


def test_trust_gate_and_duplicates(spark):
    new = records(spark, [
        (1, "Charged  twice", "We refund", "billing", True), (2, "charged twice", " we refund", "billing", True),
        (3, "x", "y", "billing", False), (4, "x", "y", "billing", None), (5, "known", "answer", "trip", True),
    ])
    existing = M.with_resolution_id(records(spark, [(0, "KNOWN", "answer", "trip", True)]))
    got = {r.seq: r.status for r in M.ingest_resolutions(new, existing).collect()}
    assert got == {1: "added", 2: "duplicate", 3: "rejected_unverified", 4: "rejected_unverified", 5: "duplicate"}


def noisy_records(rng, n, edits=16):
    base = ["charged twice for one ride yesterday", "driver cancelled my trip at the airport", "app crashes when i open the map"]
    rows = []
    for i in range(n):
        q = list(rng.choice(base))
        for _ in range(rng.randrange(0, edits)):
            q[rng.randrange(len(q))] = rng.choice("abcdefgh ")
        r = rng.choice(["we will refund the duplicate", "we refunded the duplicates", "please reinstall the app", "no refund is due here"])
        rows.append((i, "".join(q), r, rng.choice(["a", "a", "b"]), True))
    return rows


def test_conflicts_equal_brute_force_in_one_and_many_blocks(spark):
    norm = lambda t: " ".join(t.lower().split())
    ratio = lambda a, b: SequenceMatcher(None, norm(a), norm(b)).ratio()
    rows = noisy_records(random.Random(5), 90)
    old, new = [(-1, *r[1:]) for r in rows[:30]], rows[30:]
    want = {}
    for i, (seq, q, r, intent, _) in enumerate(new):
        earlier = old + new[:i]
        want[seq] = any(e[3] == intent and ratio(q, e[1]) >= 0.75 and ratio(r, e[2]) < 0.6 for e in earlier)
    assert 5 < sum(want.values()) < len(want)
    for settings in (Settings(), replace(Settings(), block_rows=25)):
        flagged = M.flag_conflicts(records(spark, new), records(spark, old), settings)
        assert {r.seq: r.conflict_flag for r in flagged.collect()} == want


def test_common_subsequences_of_many_pairs_equal_those_of_each(spark):
    rng = random.Random(3)
    few, many = "abc é", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    for letters in (few, many):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        mine = [text(n) for n in (0, 1, 2, 62, 63, 64, 125, 126, 127, 300, M.PLACES * M.WORDS)]
        theirs = [text(rng.randrange(700)) for _ in range(20)] + ["", "xyz", few]
        size = np.array([len(t) for t in mine])
        i, j = (x.ravel() for x in np.mgrid[: len(mine), : len(theirs)])
        got = M._common_of_pairs(*M._place_words(mine), size, i, theirs, j)
        want = np.array([M._common(M._places(mine[a]), len(mine[a]), theirs[b]) for a, b in zip(i, j)])
        # an alphabet that is folded may only raise the bound
        assert (got >= want).all() and (letters == many or (got == want).all())


def test_conflicts_of_long_texts_and_many_letters_equal_brute_force(spark):
    rng = random.Random(6)
    letters = "".join(map(chr, range(0x4E00, 0x4E00 + 200)))
    base = ["".join(rng.choice(s) for _ in range(n)) for s in ("abcdef", letters) for n in (100, 190, 490, 520, 600)]
    rows = []
    for i in range(100):
        q = list(rng.choice(base))
        for _ in range(rng.randrange(len(q) // rng.choice([4, 12, 40]))):
            q[rng.randrange(len(q))] = rng.choice("abcdef" + letters)
        rows.append((i, "".join(q), rng.choice(["we will refund the duplicate", "please reinstall the app"]), rng.choice(["a", None]), True))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {r[0]: any(e[3] == r[3] and ratio(r[1], e[1]) >= 0.75 and ratio(r[2], e[2]) < 0.6 for e in rows[: r[0]]) for r in rows}
    assert 3 < sum(want.values()) < len(want)
    df = records(spark, rows)
    got = {r.seq: r.conflict_flag for r in M.flag_conflicts(df, df.limit(0)).collect()}
    assert got == want


def test_token_conflicts_equal_brute_force(spark):
    rows = noisy_records(random.Random(8), 80, 3)
    sets = [(set(r[1].lower().split()), set(r[2].split())) for r in rows]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {
        r[0]: any(
            rows[e][3] == r[3] and jac(sets[i][0], sets[e][0]) >= 0.75 and jac(sets[i][1], sets[e][1]) < 0.6 for e in range(i)
        )
        for i, r in enumerate(rows)
    }
    df = records(spark, rows)
    got = {r.seq: r.conflict_flag for r in M.flag_conflicts_by_tokens(df, df.limit(0)).collect()}
    assert got == want and any(want.values())


def test_token_conflicts_shuffle_few_pairs_that_are_not_alike(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        q = [f"w{min(int(rng.expovariate(0.02)), 299)}" for _ in range(60)]
        rows.append((i, " ".join(q), rng.choice(["yes", "no"]), "a", True))
    for i in range(0, 60, 2):  # some are nearly alike
        rows[i + 1] = (i + 1, rows[i][1] + " extra", "something else", "a", True)
    sets = [(set(r[1].split()), {r[2]}) for r in rows]
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {r[0]: any(jac(sets[i][0], sets[e][0]) >= 0.75 and sets[i][1].isdisjoint(set(rows[e][2].split())) for e in range(i)) for i, r in enumerate(rows)}
    met, distinct = [], type(spark.range(1)).distinct
    monkeypatch.setattr(type(spark.range(1)), "distinct", lambda df: (met.append(df.count()) if df.columns == ["x", "y"] else None, distinct(df))[1])
    df = records(spark, rows)
    got = {r.seq: r.conflict_flag for r in M.flag_conflicts_by_tokens(df, df.limit(0)).collect()}
    assert got == want and sum(want.values()) >= 30
    assert sum(met) < 10 * len(rows)


def test_token_conflicts_in_many_files_equal_brute_force_and_shuffle_texts_only(spark, monkeypatch):
    monkeypatch.setattr(alike, "FILE_ROWS", 40)
    rng, rows = random.Random(21), []
    for i in range(500):
        kind, q = rng.choice(["a", "b", None]), [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 200, 260]))]
        if i and rng.random() < 0.3:  # an edited copy of an earlier one
            kind, q = rows[-1][3], rows[-1][1].split()
            for _ in range(rng.randrange(len(q) // 4 + 1)):
                q[rng.randrange(len(q))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(q), rng.choice(["yes", "no", "", "yes of course"]), kind, True))
    rows = [*rows, *[(500 + k, *rows[7 * k][1:]) for k in range(30)], (600, "  ", "no", "a", True), (None, *rows[3][1:]), (None, rows[4][1], "never", rows[4][3], True)]
    old, new = rows[::3], [r for k, r in enumerate(rows) if k % 3]
    sets = lambda r: (set(r[1].split()), set(r[2].split()))
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0

    def clash(a, b):
        (p, r), (q, t) = sets(a), sets(b)
        return a[3] == b[3] and (p, r) != (q, t) and jac(p, q) >= 0.75 and jac(r, t) < 0.6  # equal records fold

    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(x.totalShuffleWrite() for x in [store.executorList(True).apply(0)])
    for known in ([], old):
        mine = new if known else rows
        # a new record without a number is held as one of the memory
        before = lambda a, e: e in known or e[0] is None or e[0] < a[0]  # noqa: B023, E731
        want = Counter((a[0], a[0] is not None and any(before(a, e) and clash(a, e) for e in known + mine if e is not a)) for a in mine)
        start = shuffled()
        got = M.flag_conflicts_by_tokens(records(spark, mine), records(spark, known))
        got = Counter((r.seq, r.conflict_flag) for r in got.select("seq", "conflict_flag").collect())
        assert got == want and sum(n for (_, hit), n in want.items() if hit) > 30
        assert shuffled() - start < 4 * sum(len(r[1]) for r in known + mine)


def machine(events):
    """Plain replay of one conversation: (kind, role, status) to final state and counts."""
    state, rejected, reopened, log = "AI_ACTIVE", 0, 0, []
    for kind, role, status in events:
        before, bad, again = state, False, False
        target = {"escalate": "WAITING_FOR_HUMAN", "resolve": "RESOLVED", "close": "CLOSED", "set_status": status}.get(kind)
        if kind == "message":
            if role == "customer" and state in ("RESOLVED", "CLOSED"):
                state, again = "WAITING_FOR_HUMAN", True
            elif role == "human" and state == "WAITING_FOR_HUMAN":
                state = "HUMAN_ACTIVE"
        elif target in fixed.STATES and (target == state or target in fixed.TRANSITIONS[state]):
            state = target
        else:
            bad = True
        rejected, reopened = rejected + bad, reopened + again
        log.append((before, state, bad, again))
    return state, rejected, reopened, log


def test_replay_equals_a_plain_machine_for_any_stretch(spark):
    rng = random.Random(11)
    kinds = ["message", "escalate", "resolve", "close", "set_status"]
    rows, events = [], {}
    for seq in range(700):
        conv = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
        kind = rng.choice(kinds)
        role = rng.choice(["customer", "human", "ai", "system"]) if kind == "message" else None
        status = rng.choice([*fixed.STATES, "LOST"]) if kind == "set_status" else None
        rows.append((conv, seq, kind, role, status))
        events.setdefault(conv, []).append((kind, role, status))
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, status string")
    df = df.withColumn("code", L.event_code(F.col("kind"), F.col("role"), F.col("status")))
    want = {c: machine(e) for c, e in events.items()}
    for size in (3, 64):
        got = L.replay_states(df, order=["seq"], chunk=int_chunk("seq", 100), stretch_rows=size).collect()
        assert {r.conv_id: (r.status, r.n_rejected, r.n_reopened) for r in got} == {c: w[:3] for c, w in want.items()}
        log = L.replay_log(df, order=["seq"], chunk=int_chunk("seq", 100), stretch_rows=size).orderBy("seq").collect()
        for conv in events:
            mine = [(r.status_before, r.status_after, r.rejected, r.reopened) for r in log if r.conv_id == conv]
            assert mine == want[conv][3]


def test_replay_plan_is_jvm_only(spark):
    df = spark.createDataFrame([(1, 1, 0)], "conv_id long, seq long, code int")
    plan = L.replay_states(df, order=["seq"], chunk=int_chunk("seq"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_double_submit_and_reopen(spark):
    rows = [(1, 0, "customer", "hi", False), (1, 1, "customer", "hi", False), (1, 2, "ai", "hi", False), (1, 3, "customer", "hi", False), (1, 4, "customer", "hi", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, again boolean")
    assert [r.turn for r in L.drop_consecutive_dups(df).orderBy("turn").collect()] == [0, 2, 3]
    assert [r.turn for r in L.drop_consecutive_dups(df, reopened="again").orderBy("turn").collect()] == [0, 2, 3, 4]


def test_counts_queue_and_roles(spark):
    df = spark.createDataFrame([("a", "CLOSED", 2), ("b", None, 1), ("c", "CLOSED", 3)], "conversation_id string, status string, updated_at long")
    counts = {r.status: r.n for r in L.status_counts(df).collect()}
    assert counts == {"AI_ACTIVE": 1, "WAITING_FOR_HUMAN": 0, "HUMAN_ACTIVE": 0, "RESOLVED": 0, "CLOSED": 2}
    assert [r.conversation_id for r in L.queue(df, "CLOSED").collect()] == ["c", "a"]
    bad = spark.createDataFrame([("customer",), ("robot",), (None,)], "role string")
    assert sorted(str(r.role) for r in L.invalid_roles(bad).collect()) == ["None", "robot"]


def test_changed_mind_and_second_thumbs_down(spark):
    rows = [(1, "m1", "not_helpful"), (2, "m1", "not_helpful"), (3, "m1", "helpful"), (4, "m2", "not_helpful"), (5, "m1", "not_helpful"), (6, "m3", "human_request")]
    df = spark.createDataFrame([(e, "c", m, k) for e, m, k in rows], "event_id long, conversation_id string, message_id string, feedback string")
    order = ("event_id",)
    got = routing.apply_feedback(df, order=order, chunk=int_chunk("event_id", 2)).orderBy("event_id").collect()
    assert [r.thumbs_down_count for r in got] == [1, 1, 0, 1, 2, 2]
    assert [r.escalated for r in got] == [False, False, False, False, True, True]
    changed = M.feedback_changes(df, order=order, chunk=int_chunk("event_id", 2)).orderBy("event_id").collect()
    assert [r.changed for r in changed] == [True, False, True, True, True, True]
    assert [r.escalate_now for r in routing.feedback_policy(got and spark.createDataFrame(got)).orderBy("event_id").collect()] == [True, True, False, True, True, True]
    stats = M.feedback_stats(df).first()
    assert (stats.total, stats.helpful, stats.not_helpful, stats.human_request) == (6, 1, 4, 1)
    assert not M.log_feedback(df).where("trusted OR validated").count()
