"""Lifecycle fold (M10): an ordered event log per notification -> its history and final row.

Events: create, lock (pending -> processing, which rests until an outcome), limited (the
limiter's refusal: retry at +10 s), outcome (webhook result), cancel, and attempt, a lock and
its outcome at one instant.  An outcome or refusal of a row that is not processing changes
nothing.  Timers are applied lazily before each event: a due retry is swept back to pending at its
``next_retry_at``; a row stuck in processing for five minutes is swept like the zombie
sweep.  The fold streams per id through ``stream_fold`` (sorted partitions, no group is
ever held whole).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.operators.fold import stream_fold

# Fixed values of the delivery rules (microseconds).
MAX_RETRIES = 3
ZOMBIE_US = 5 * 60 * 1_000_000
MINUTE_US = 60 * 1_000_000
RATE_LIMIT_US = 10 * 1_000_000
TERMINAL = ("delivered", "failed_permanently", "canceled")
RANK = {"create": 0, "attempt": 1, "lock": 1, "limited": 2, "outcome": 2, "cancel": 3}


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def event_log(notifications: DataFrame, attempts: DataFrame, cancels: DataFrame,
              known_ids: DataFrame | None = None, locks: DataFrame | None = None,
              refusals: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """Union of the event kinds with a total order (t, rank, tie columns).  ``locks`` and
    ``refusals`` (id, ts) and ``outcomes`` (id, ts, http_status, message_id) are optional.
    Cancels, locks, refusals and outcomes of unknown ids are dropped (``known_ids``, default
    the notifications' ids)."""
    cols = ["id", "t", "rank", "kind", "http_status", "message_id", "attempt_no", "latency_s"]
    types = {"http_status": "int", "message_id": "string", "attempt_no": "int", "latency_s": "double"}
    known = known_ids if known_ids is not None else notifications.select("id")

    def of(df: DataFrame, kind: str, ts: str, carried=()) -> DataFrame:
        return df.select("id", _us(ts).alias("t"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("kind"),
                         *[F.col(c) if c in carried else F.lit(None).cast(t).alias(c) for c, t in types.items()])

    log = of(notifications, "create", "created_at").unionByName(of(attempts, "attempt", "attempt_ts", types))
    for df, kind, carried in ((locks, "lock", ()), (refusals, "limited", ()),
                              (outcomes, "outcome", ("http_status", "message_id")), (cancels, "cancel", ())):
        if df is not None:
            log = log.unionByName(of(df.join(known, "id", "left_semi"), kind, "ts", carried))
    return log.select(*cols)


def _outcome(http):
    if http is None or http >= 500 or http in (429, 408):
        return "retriable"
    if 200 <= http <= 299:
        return "delivered"
    return "permanent"


def apply_timers(s: dict, t: int, max_retries: int = MAX_RETRIES) -> None:
    """Timers due before time ``t``: retry sweep at next_retry_at, zombie sweep after
    five minutes in processing."""
    st = s["status"]
    if st == "failed_retrying" and s["next"] is not None and s["next"] <= t:
        s.update(status="pending", upd=s["next"], n=s["n"] + 1)
    elif st == "processing" and s["upd"] is not None and s["upd"] < t - ZOMBIE_US:
        if s["retry"] < max_retries:
            s.update(status="pending", retry=s["retry"] + 1)
        else:
            s["status"] = "failed_permanently"
        s.update(upd=s["upd"] + ZOMBIE_US, n=s["n"] + 1, zombies=s["zombies"] + 1)


def new_row() -> dict:
    """The state of an id nothing is known of."""
    return {"status": None, "retry": 0, "next": None, "ext": None, "upd": None, "n": 0, "zombies": 0, "refusals": 0}


def next_timer(s: dict):
    """When the next timer of the row fires (microseconds), or None."""
    if s["status"] == "failed_retrying" and s["next"] is not None:
        return s["next"]
    if s["status"] == "processing" and s["upd"] is not None:
        return s["upd"] + ZOMBIE_US + 1
    return None


def _apply_outcome(s: dict, t: int, http, mid, max_retries: int) -> None:
    oc = _outcome(None if http is None or http != http else int(http))
    r = s["retry"]
    if oc == "delivered":
        s.update(status="delivered", ext=(mid or None))
    elif oc == "retriable" and r + 1 < max_retries:
        s.update(status="failed_retrying", retry=r + 1, next=t + (2 ** r) * MINUTE_US)
    else:
        s.update(status="failed_permanently", retry=r + 1, next=None)
    s.update(upd=t, n=s["n"] + 1)


def apply_event(s: dict, t: int, kind: str, http, mid, max_retries: int = MAX_RETRIES) -> None:
    """One event on the row state ``s`` (timers first)."""
    apply_timers(s, t, max_retries)
    st = s["status"]
    if kind == "create":
        if st is None:
            s.update(status="pending", retry=0, next=None, ext=None, upd=t, n=s["n"] + 1)
    elif kind in ("lock", "attempt"):
        if st == "pending":
            s.update(status="processing", upd=t, n=s["n"] + 1)
            if kind == "attempt":                 # the outcome of the lock just taken
                _apply_outcome(s, t, http, mid, max_retries)
    elif kind == "outcome":
        if st == "processing":
            _apply_outcome(s, t, http, mid, max_retries)
    elif kind == "limited":
        if st == "processing":
            s.update(status="failed_retrying", next=t + RATE_LIMIT_US, upd=t, n=s["n"] + 1, refusals=s["refusals"] + 1)
    elif kind == "cancel":
        if st in ("pending", "failed_retrying"):
            s.update(status="canceled", upd=t, n=s["n"] + 1)


def lifecycle_fold(events: DataFrame, max_retries: int = MAX_RETRIES, last_only: bool = False) -> DataFrame:
    """Per event (``last_only``: for the last event of each id), the row state after it: status, retry_count, next_retry_us,
    external_id, updated_us, the number of transitions so far (``moves``) and of these the
    zombie sweeps and the limiter's refusals."""

    def step(s, t, kind, http, mid):
        apply_event(s, t, kind, http, mid, max_retries)
        return s["status"], s["retry"], s["next"], s["ext"], s["upd"], s["n"], s["zombies"], s["refusals"]

    return stream_fold(events, ["id"], ["t", "rank", "attempt_no", "http_status", "message_id", "latency_s"],
                       ["t", "kind", "http_status", "message_id"], new_row, step,
                       [("status", "string"), ("retry_count", "int"), ("next_retry_us", "long"),
                        ("external_id", "string"), ("updated_us", "long"), ("moves", "int"), ("zombies", "int"), ("refusals", "int")],
                       only="last" if last_only else None)


def final_rows(folded: DataFrame) -> DataFrame:
    """The state after each id's last event (``max_by`` per id, partial aggregate)."""
    last = F.max_by(F.struct("status", "retry_count", "next_retry_us", "external_id", "updated_us", "moves", "zombies", "refusals"),
                    F.struct("t", "rank", "attempt_no", F.coalesce("http_status", F.lit(-1)),
                             "message_id", "latency_s"))
    g = folded.groupBy("id").agg(last.alias("s"))
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return g.select("id", "s.status", "s.retry_count", ts(F.col("s.next_retry_us")).alias("next_retry_at"),
                    "s.external_id", ts(F.col("s.updated_us")).alias("updated_at"), "s.moves", "s.zombies", "s.refusals")
