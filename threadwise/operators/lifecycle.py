"""Conversation lifecycle: the guarded state machine, queues, counts and cards.

The state machine is replayed as a product of small maps. One event is a map "state before -> state
after" over the five states, and maps compose associatively. So a conversation's events are cut
into stretches, each stretch becomes one map wherever it lies, and only maps are brought together
per conversation. A user with a third of all events costs no more per task than anyone else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise import fixed_values as fixed
from threadwise.operators.ordered import hot_time_chunk, int_chunk, with_neighbour
from threadwise.operators.threads import first_per

STRETCH_ROWS = 1024
INITIAL = "AI_ACTIVE"
WAITING, HUMAN_ACTIVE, RESOLVED, CLOSED = fixed.STATES[1:]

# Event codes: 0 plain message, 1 customer message, 2 human message, 3 escalate,
# 4.. move to the state with that position, last = unknown.
MOVE = 4
UNKNOWN = MOVE + len(fixed.STATES)


def step_table() -> list[list[tuple[int, int, int]]]:
    """For every event code and state: (next state, rejected, reopened)."""
    at = {s: i for i, s in enumerate(fixed.STATES)}

    def move(state: str, target: str) -> tuple[int, int, int]:
        if target == state or target in fixed.TRANSITIONS[state]:
            return at[target], 0, 0
        return at[state], 1, 0

    table = []
    for code in range(UNKNOWN + 1):
        row = []
        for state in fixed.STATES:
            if code == 1 and state in (RESOLVED, CLOSED):
                row.append((at[WAITING], 0, 1))
            elif code == 2 and state == WAITING:
                row.append((at[HUMAN_ACTIVE], 0, 0))
            elif code == 3:
                row.append(move(state, WAITING))
            elif MOVE <= code < UNKNOWN:
                row.append(move(state, fixed.STATES[code - MOVE]))
            else:
                row.append((at[state], int(code == UNKNOWN), 0))
        table.append(row)
    return table


def event_code(kind: Column, role: Column, status: Column) -> Column:
    """Lifecycle event to its code in ``step_table``."""
    target = F.lit(UNKNOWN)
    for i, state in enumerate(fixed.STATES):
        target = F.when(status == state, MOVE + i).otherwise(target)
    return (
        F.when(
            kind == "message",
            F.when(role == "customer", 1).when(role == "human", 2).otherwise(0),
        )
        .when(kind == "escalate", 3)
        .when(kind == "resolve", MOVE + fixed.STATES.index(RESOLVED))
        .when(kind == "close", MOVE + fixed.STATES.index(CLOSED))
        .when(kind == "set_status", target)
        .otherwise(UNKNOWN)
    )


def _steps() -> Column:
    flat = [F.struct(*[F.lit(v).cast("long") for v in cell]) for row in step_table() for cell in row]
    return F.array(*flat).cast("array<struct<s: bigint, rejected: bigint, reopened: bigint>>")


def _cell(state: Column, rejected: Column, reopened: Column) -> Column:
    return F.struct(state.alias("s"), rejected.alias("rejected"), reopened.alias("reopened"))


def _identity() -> Column:
    zero = F.lit(0).cast("long")
    return F.array(*[_cell(F.lit(i).cast("long"), zero, zero) for i in range(len(fixed.STATES))])


def _then(done: Column, nxt: Column) -> Column:
    """Cells after applying ``nxt`` (a map) to every cell of ``done``."""
    return F.transform(
        done,
        lambda c: _cell(
            F.get(nxt, c["s"].cast("int"))["s"],
            c["rejected"] + F.get(nxt, c["s"].cast("int"))["rejected"],
            c["reopened"] + F.get(nxt, c["s"].cast("int"))["reopened"],
        ),
    )


def _fold_events(codes: Column) -> Column:
    width = len(fixed.STATES)

    def step(acc: Column, e: Column) -> Column:
        def apply(c: Column) -> Column:
            cell = F.get(F.col("_steps"), (e["code"] * width + c["s"]).cast("int"))
            return _cell(cell["s"], c["rejected"] + cell["rejected"], c["reopened"] + cell["reopened"])

        return F.transform(acc, apply)

    return F.aggregate(codes, _identity(), step)


def _fold_maps(maps: Column) -> Column:
    return F.aggregate(maps, _identity(), lambda acc, m: _then(acc, m["map"]))


def _stretches(
    events: DataFrame, key: str, order: Sequence[str], chunk: Column, rows: int
) -> DataFrame:
    """One row per (key, chunk, stretch): its events in order, at most ``rows`` of them."""
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    return (
        events.withColumn("_chunk", chunk)
        .withColumn("_part", F.floor((F.row_number().over(w) - 1) / rows))
        .groupBy(key, "_chunk", "_part")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "code"))).alias("_events"))
    )


def conversation_maps(
    events: DataFrame,
    key: str = "conv_id",
    order: Sequence[str] = ("ts", "seq"),
    chunk: Column | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """(key, n, map): the number of a conversation's events and what they make of each state.

    ``events`` carries ``code`` (see ``event_code``). The events are shuffled once, on (key, chunk);
    what is shuffled on the key alone is one map of five cells per chunk. Unless a chunk is given,
    only conversations with very many events are cut, by rows.
    """
    events = events.select(key, *order, "code")
    if chunk is None:
        events, chunk = hot_time_chunk(events, key, order[0])
    parts = _stretches(events, key, order, chunk, stretch_rows)
    maps = parts.withColumn("_steps", _steps()).select(
        key, "_chunk", "_part", F.size("_events").alias("n"), _fold_events(F.col("_events")).alias("map")
    )
    for level, at in (([key, "_chunk"], "_part"), ([key], "_chunk")):
        maps = maps.groupBy(*level).agg(
            F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(at, "map"))).alias("_maps")
        )
        maps = maps.select(*level, "n", _fold_maps(F.col("_maps")).alias("map"))
    return maps


def applied(map_: str, status: Column) -> Column:
    """What a map makes of a state: (status, rejected, reopened); the state itself where there is no map."""
    zero = F.lit(0).cast("long")
    at = F.coalesce(F.array_position(_state_names(), status), F.lit(fixed.STATES.index(INITIAL) + 1)).cast("int") - 1
    cell = F.get(map_, at)
    return F.struct(
        F.get(_state_names(), F.coalesce(cell["s"].cast("int"), at)).alias("status"),
        F.coalesce(cell["rejected"], zero).alias("rejected"),
        F.coalesce(cell["reopened"], zero).alias("reopened"),
    )


def replay_states(
    events: DataFrame,
    key: str = "conv_id",
    order: Sequence[str] = ("ts", "seq"),
    chunk: Column | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Final status per conversation, with the number of rejected moves and of reopenings."""
    maps = conversation_maps(events, key, order, chunk, stretch_rows)
    end = maps.select(key, "n", applied("map", F.lit(INITIAL)).alias("e"))
    return end.select(key, "e.status", F.col("n").alias("n_events"), F.col("e.rejected").alias("n_rejected"), F.col("e.reopened").alias("n_reopened"))


def _state_names() -> Column:
    return F.array(*[F.lit(s) for s in fixed.STATES])


def _starts(maps: str, start: Column) -> Column:
    """State before each map of an ordered list, given the state before the first."""
    zero = F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("seen"))
    walked = F.aggregate(
        F.col(maps),
        zero,
        lambda acc, m: F.struct(
            F.get(m["map"], acc["s"].cast("int"))["s"].alias("s"),
            F.concat(acc["seen"], F.array(acc["s"])).alias("seen"),
        ),
    )
    return walked["seen"]


def replay_log(
    events: DataFrame,
    key: str = "conv_id",
    order: Sequence[str] = ("ts", "seq"),
    chunk: Column | None = None,
    stretch_rows: int = 256,
) -> DataFrame:
    """Every event with the state before and after it and whether the move was rejected.

    Maps go up (stretch, chunk), start states come down again, and each stretch is then replayed
    on its own.
    """
    events = events.select(key, *order, "code")
    if chunk is None:
        events, chunk = hot_time_chunk(events, key, order[0])
    parts = _stretches(events, key, order, chunk, stretch_rows)
    parts = parts.withColumn("_steps", _steps()).withColumn("map", _fold_events(F.col("_events")))
    chunks = parts.groupBy(key, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_part", "map"))).alias("_maps")
    )
    chunks = chunks.withColumn("map", _fold_maps(F.col("_maps")))
    threads = chunks.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_chunk", "map"))).alias("_all")
    )
    first = F.lit(fixed.STATES.index(INITIAL))
    chunk_start = threads.select(
        key,
        F.explode(
            F.arrays_zip(
                F.transform("_all", lambda m: m["_chunk"]).alias("_chunk"),
                _starts("_all", first).alias("_start"),
            )
        ).alias("z"),
    ).select(key, "z._chunk", "z._start")
    part_start = (
        chunks.select(key, "_chunk", "_maps")
        .join(chunk_start, [key, "_chunk"])
        .select(
            key,
            "_chunk",
            F.explode(
                F.arrays_zip(
                    F.transform("_maps", lambda m: m["_part"]).alias("_part"),
                    _starts("_maps", F.col("_start")).alias("_begin"),
                )
            ).alias("z"),
        )
        .select(key, "_chunk", "z._part", "z._begin")
    )
    width = len(fixed.STATES)
    after = lambda s, e: F.get(F.col("_steps"), (e["code"] * width + s).cast("int"))
    walk = F.aggregate(
        "_events",
        F.struct(F.col("_begin").alias("s"), F.array().cast("array<bigint>").alias("seen")),
        lambda acc, e: F.struct(
            after(acc["s"], e)["s"].alias("s"),
            F.concat(acc["seen"], F.array(acc["s"])).alias("seen"),
        ),
    )
    played = parts.join(part_start, [key, "_chunk", "_part"]).withColumn("_walk", walk["seen"])
    rows = played.select(
        key, "_steps", F.explode(F.arrays_zip(F.col("_events"), F.col("_walk"))).alias("z")
    )
    event = F.col("z._events")
    cell = after(F.col("z._walk"), event)
    names = _state_names()
    return rows.select(
        key,
        *[event[c].alias(c) for c in order],
        event["code"].alias("code"),
        F.get(names, F.col("z._walk").cast("int")).alias("status_before"),
        F.get(names, cell["s"].cast("int")).alias("status_after"),
        (cell["rejected"] == 1).alias("rejected"),
        (cell["reopened"] == 1).alias("reopened"),
    )


def system_notes(
    log: DataFrame, escalate: Column, reason: Column, key: str = "conv_id", order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """The system messages of a replayed log: one before a message that reopens its conversation, one behind
    an escalation of a conversation that was not waiting already. ``escalate`` marks such events."""
    queued = escalate & ~F.col("rejected") & (F.col("status_before") != fixed.STATES[1])
    notes = F.array_compact(
        F.array(
            F.when(F.col("reopened"), F.lit(fixed.REOPENED_NOTE)),
            F.when(queued, F.concat(F.lit(fixed.ESCALATED_NOTE), reason)),
        )
    )
    rows = log.select(key, *order, F.explode(notes).alias("text"))
    return rows.withColumn("role", F.lit("system"))


def drop_consecutive_dups(
    conv: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    reopened: str | None = None,
) -> DataFrame:
    """Drop a message equal in role and text to the one before it (a double submit).

    ``reopened`` names a flag of messages that reopened their conversation; a system note stands
    before those, so they are kept.
    """
    near = with_neighbour(conv, [key], [order], int_chunk(order), ["role", "text"], "_prev")
    same = (F.col("_prev.role") == F.col("role")) & F.col("_prev.text").eqNullSafe(F.col("text"))
    if reopened:
        same = same & ~F.col(reopened)
    return near.where(~F.coalesce(same, F.lit(False))).drop("_prev")


def queue(conv: DataFrame, status: str | None = None, newest: str = "updated_at", key: str = "conversation_id") -> DataFrame:
    """Conversations, newest first, of one status or of all."""
    chosen = conv if status is None else conv.where(F.col("status") == status)
    return chosen.orderBy(F.desc(newest), key)


def status_counts(conv: DataFrame) -> DataFrame:
    """Conversations per state; states without any count 0, a missing status is the initial one."""
    states = conv.sparkSession.createDataFrame([(s,) for s in fixed.STATES], "status string")
    counts = conv.groupBy(F.coalesce("status", F.lit(INITIAL)).alias("status")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    joined = states.join(counts, "status", "full")
    return joined.select("status", F.coalesce("_n", F.lit(0)).alias("n"))


def conversation_summary(
    conv: DataFrame,
    status: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    customer: str = "user",
    n: int = 60,
) -> DataFrame:
    """A card per conversation: first customer text (shortened), status, intent.

    The first text is taken as a rank-1 filter before the shuffle, so long threads stay cheap.
    """
    first = first_per(conv.where(F.col("role") == customer), [key], [order]).select(
        key, F.substring("text", 1, n).alias("first_text")
    )
    return status.join(first, key, "left").withColumn(
        "first_text", F.coalesce("first_text", F.lit("(no message)"))
    )


def invalid_roles(df: DataFrame, roles: Sequence[str] = fixed.ROLES) -> DataFrame:
    """Messages with a role outside the list, for a quarantine table."""
    return df.where(~F.coalesce(F.col("role").isin(list(roles)), F.lit(False)))
