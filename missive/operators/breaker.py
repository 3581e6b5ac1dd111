"""Circuit breaker replay.

Rules (times in seconds): failures are counted in a window that starts at the first
failure; at ``max_failures`` the breaker opens for ``open_s``; for 5 s after that it is
half-open and lets one probe through (probe lock 10 s); any executed success clears
everything; a failed probe re-opens at once.  A key is alive iff ``t < set + ttl``.
Each name's timeline is cut at idle gaps >= every expiry and folded in parallel.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.operators.fold import HOUR_US, segment_by_bins, segment_by_gap, stream_fold
from missive.operators.ordering import binned_running

# Fixed values of the breaker.
HALF_OPEN_EXTRA_S = 5
PROBE_LOCK_S = 10


def _alive(until, t):
    return until is not None and t < until


def breaker_replay(calls: DataFrame, name: str = "name", ts: str = "ts", ok: str = "ok",
                   order: str = "call_id", max_failures: int = 10, window_s: int = 10,
                   open_s: int = 30, trips_only: bool = False, keep: list | None = None) -> DataFrame:
    """B1: per call, ``verdict`` in {closed, probe, open}, ``executed`` and ``tripped``
    (this call opened the breaker).  ``trips_only``: every call is replayed, those that
    trip are returned.  ``keep``: the columns of the calls to return (all if not given), by
    name or as columns made of them."""
    d = calls.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    reset_us = max(open_s + HALF_OPEN_EXTRA_S, window_s, PROBE_LOCK_S) * 1_000_000
    seg = segment_by_bins(d, name, "_us", reset_us)
    open_us, half_us = open_s * 1_000_000, (open_s + HALF_OPEN_EXTRA_S) * 1_000_000
    win_us, lock_us = window_s * 1_000_000, PROBE_LOCK_S * 1_000_000

    def init():
        return {"state": None, "half": None, "probe": None, "fails": 0, "fails_until": None}

    def step(s, t, good):
        trip = False
        if _alive(s["state"], t):
            v = "open"
        elif _alive(s["half"], t):
            if _alive(s["probe"], t):
                v = "open"
            else:
                s["probe"] = t + lock_us
                v = "probe"
        else:
            v = "closed"
        run = v != "open"
        if run and good:                       # any executed success clears every key
            s.update(state=None, half=None, probe=None, fails=0, fails_until=None)
        elif run and v == "probe":             # a failed probe re-opens at once
            s.update(state=t + open_us, half=t + half_us, probe=None)
            trip = True
        elif run:
            if not _alive(s["fails_until"], t):
                s["fails"], s["fails_until"] = 1, t + win_us
            else:
                s["fails"] += 1
            if s["fails"] >= max_failures:
                s.update(state=t + open_us, half=t + half_us, fails=0, fails_until=None)
                trip = True
        return v, run, trip

    def skip(s, columns, i, end):
        """Refused calls change nothing while the breaker is open, nor do successes once all is clear."""
        t, good = columns
        if _alive(s["state"], t[i]):
            return bisect_left(t, s["state"], i, end), ("open", False, False)
        if s["state"] is None and s["fails"] == 0:
            while i < end and good[i] is True:
                i += 1
        return i, ("closed", True, False)

    # sorted by piece before name: Spark compares the first column of a sort as a number, and names are few
    res = stream_fold(seg, ["_seg", name], ["_us", order], ["_us", ok], init, step,
                      [("verdict", "string"), ("executed", "boolean"), ("tripped", "boolean")],
                      only="tripped" if trips_only else None, keep=keep, skip=skip)
    return res.drop("_us", "_seg")


def breaker_intervals(replayed: DataFrame, name: str = "name", ts: str = "ts",
                      open_s: int = 30) -> DataFrame:
    """B2: one open interval [opened_at, closes_at) per trip; intervals of a name never
    overlap (a new trip needs the previous state key to have expired)."""
    t = replayed.where(F.col("tripped"))
    return t.select(name, F.col(ts).alias("opened_at"),
                    (F.col(ts) + F.make_dt_interval(secs=F.lit(open_s))).alias("closes_at"))


def breaker_open_at(fetches: DataFrame, trips: DataFrame, name: str = "name", ts: str = "ts",
                    open_s: int = 30) -> DataFrame:
    """Is the breaker open at each fetch time, i.e. is there a trip within ``open_s``
    before the fetch (an aggregate of the trips per time bucket, no pair join)?"""
    from missive.operators.joins import any_before
    key = F.struct(F.col(name).alias("k"))       # a missing name is a name like any other
    m = any_before(fetches.withColumn("_name", key), trips.select(key.alias("_name"), ts), "_name", ts, ts, open_s, "breaker_open")
    return m.drop("_name")


def _cut_idle(ev: DataFrame, name: str, order: str, expiry_us: int) -> DataFrame:
    """Segments of each name's events: a start opens one where no call that will end is in
    flight and every expiry set by an earlier event has passed (the state is empty there)."""
    along = ["_us", "_phase", order]
    ev = binned_running(ev, [name], [F.col(c) for c in along], F.floor(F.col("_us") / F.lit(HOUR_US)),
                        F.col("_step"), "sum", "_flight")
    idle = (F.col("_kind") == 1) & (F.col("_flight") == F.col("_step")) & (F.col("_us") - F.col("_prev") >= expiry_us)
    return segment_by_gap(ev, name, "_us", along, idle)


def breaker_concurrent(calls: DataFrame, name: str = "name", start: str = "ts", end: str = "end_ts",
                       ok: str = "ok", order: str = "call_id", max_failures: int = 10,
                       window_s: int = 10, open_s: int = 30) -> DataFrame:
    """Calls with a start (check, probe lock) and an end (outcome).  Starts and ends
    are interleaved per name in time order; the probe flag travels from a call's start
    to its end inside the state (the in-flight calls of one name)."""
    # at one instant: ends of calls started earlier, then starts, then ends of calls that
    # also started at that instant (a zero-length call ends after its own start)
    calls = calls.withColumn("_ends", F.coalesce(F.col(end) >= F.col(start), F.lit(False)).cast("int"))
    ev = (calls.select(name, order, ok, F.col(start).alias("_t"), F.lit(1).alias("_kind"),
                       F.lit(1).alias("_phase"), F.col("_ends").alias("_step"))
          .unionByName(calls.select(name, order, ok, F.col(end).alias("_t"), F.lit(0).alias("_kind"),
                                    F.when(F.col(end) > F.col(start), 0).otherwise(2).alias("_phase"),
                                    (-F.col("_ends")).alias("_step"))))
    ev = ev.withColumn("_us", F.unix_micros(F.col("_t").cast("timestamp")))
    ev = _cut_idle(ev, name, order, max(open_s + HALF_OPEN_EXTRA_S, window_s, PROBE_LOCK_S) * 1_000_000)
    open_us, half_us = open_s * 1_000_000, (open_s + HALF_OPEN_EXTRA_S) * 1_000_000
    win_us, lock_us = window_s * 1_000_000, PROBE_LOCK_S * 1_000_000

    def init():
        return {"state": None, "half": None, "probe": None, "fails": 0, "fails_until": None, "flight": {}}

    def step(s, t, kind, cid, good):
        if kind == 1:                                   # start: the check
            if _alive(s["state"], t):
                v = "open"
            elif _alive(s["half"], t):
                if _alive(s["probe"], t):
                    v = "open"
                else:
                    s["probe"] = t + lock_us
                    v = "probe"
            else:
                v = "closed"
            if v != "open":
                s["flight"][cid] = v == "probe"
            return v, v != "open", False
        probe = s["flight"].pop(cid, None)             # end: the outcome of an executed call
        if probe is None:
            return None, False, False
        if good:
            s.update(state=None, half=None, probe=None, fails=0, fails_until=None)
            return None, True, False
        if probe:
            s.update(state=t + open_us, half=t + half_us, probe=None)
            return None, True, True
        if _alive(s["state"], t):
            return None, True, False
        if not _alive(s["fails_until"], t):
            s["fails"], s["fails_until"] = 1, t + win_us
        else:
            s["fails"] += 1
        if s["fails"] >= max_failures:
            s.update(state=t + open_us, half=t + half_us, fails=0, fails_until=None)
            return None, True, True
        return None, True, False

    res = stream_fold(ev, [name, "_seg"], ["_us", "_phase", order], ["_us", "_kind", order, ok], init, step,
                      [("verdict", "string"), ("executed", "boolean"), ("tripped", "boolean")])
    starts = res.where("_kind = 1").select(name, order, "verdict", "executed")
    ends = res.where("_kind = 0").select(name, order, F.col("tripped"))
    return starts.join(ends, [name, order])
