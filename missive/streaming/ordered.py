"""Limiters over a stream whose rows come out of order.

A row waits in keyed state until the watermark has passed its time bin; then the bins of a key
are released in time order, each sorted on its own, and go through the key's limiter.  So rows
that change places across micro-batches (by less than the watermark's delay) get the verdict of
the batch operator.  Waiting rows lie in a map state, one entry per time bin: a micro-batch
reads and writes the bins it meets, a release holds one bin at a time, and no frame ever holds a
whole key.  One event-time timer per key stands at the end of its first waiting bin; when
nothing waits it stands where the limiter's state equals a new key's, and clears the state.

Rows behind the watermark are dropped by the engine's rule; rows whose bin the watermark has not
passed when the input ends stay in the state for the next run.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from missive.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def map_state(spark: SparkSession):
    """Streams started inside use the state store that offers map state; the session's setting
    is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class SlidingLog:
    """L2: the admitted times (ms) of the last window."""

    schema = "log array<bigint>"
    extra = [("allowed", T.BooleanType())]

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def new(self):
        return ([],)

    def step(self, state, us, _weight):
        ms = us // 1000
        log = [x for x in state[0] if x > ms - self.window_ms]
        allowed = len(log) < self.limit
        if allowed:
            log.append(ms)
        return (log,), (allowed,)

    def fresh_at_ms(self, state):
        return state[0][-1] + self.window_ms if state[0] else 0


class TokenBucket:
    """L3 in whole units: the tokens and the time (us) of the last refill."""

    schema = "tokens bigint, last bigint"
    extra = [("allowed", T.BooleanType()), ("tokens_left", T.DoubleType())]

    def __init__(self, capacity: float, rate: float):
        from missive.operators.token_bucket import amounts
        self.unit, self.per_us, self.full = amounts(capacity, rate)

    def new(self):
        return (self.full, None)

    def step(self, state, us, weight):
        tokens, last = state
        if last is not None:
            tokens = min(self.full, tokens + max(0, us - last) * self.per_us)
        allowed = tokens >= weight * self.unit
        if allowed:
            tokens -= weight * self.unit
        return (tokens, us), (allowed, tokens / self.unit)

    def fresh_at_ms(self, state):
        tokens, last = state
        return 0 if last is None else (last - (tokens - self.full) // self.per_us) // 1000 + 1


class OrderedLimiter(StatefulProcessor):
    def __init__(self, limiter, key: str, order: str, bin_ms: int):
        self.limiter, self.key, self.order, self.bin_ms = limiter, key, order, bin_ms

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bin bigint", "us array<bigint>, n array<bigint>, w array<bigint>")
        self.state = handle.getValueState("limiter", self.limiter.schema)
        self.timer = handle.getValueState("timer", "at bigint")

    def _set_timer(self, at: int | None):
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            for b, part in pdf.groupby(pdf["at_us"] // (self.bin_ms * 1000)):
                b = int(b)
                new = [part[c].tolist() for c in ("at_us", self.order, "asked")]
                if self.waiting.containsKey((b,)):
                    new = [list(old) + more for old, more in zip(self.waiting.getValue((b,)), new)]
                self.waiting.updateValue((b,), tuple(new))
                first = b if first is None else min(first, b)
        if first is not None:
            end = (first + 1) * self.bin_ms
            now = self.timer.get()[0] if self.timer.exists() else None
            # a timer of an earlier bin stays; one that stood for the clearing gives way
            if now is None or end < now or not self._stands_for_bin(now):
                self._set_timer(end)
        return iter(())

    def _stands_for_bin(self, at: int) -> bool:
        return at % self.bin_ms == 0 and self.waiting.containsKey((at // self.bin_ms - 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        bins = sorted(k[0] for k in self.waiting.keys())
        ready = [b for b in bins if (b + 1) * self.bin_ms <= mark]
        state = self.state.get() if self.state.exists() else self.limiter.new()
        for b in ready:
            rows = sorted(zip(*self.waiting.getValue((b,))))
            out = []
            for us, n, w in rows:
                state, verdict = self.limiter.step(state, us, w)
                out.append((n, key[0], *verdict))
            self.waiting.removeKey((b,))
            yield pd.DataFrame(out, columns=[self.order, self.key, *[c for c, _t in self.limiter.extra]])
        if len(bins) > len(ready):
            self.state.update(tuple(state))
            self._set_timer((bins[len(ready)] + 1) * self.bin_ms)
            return
        fresh = self.limiter.fresh_at_ms(state)
        if fresh <= mark:
            self.state.clear()
        else:
            self.state.update(tuple(state))
            self._set_timer(fresh)

    def close(self):
        pass


def ordered_limit_stream(reqs: DataFrame, key: str, ts: str, order: str, weight: str | None, limiter,
                         bin_ms: int = 60_000, delay: str = "1 hour") -> DataFrame:
    """``order``, ``key`` and the limiter's verdict per row, in the order of (``ts``,
    ``order``) whatever the order of arrival; start it inside ``map_state``.  ``delay``: how late
    a row may come; ``bin_ms``: width of the bins that wait and are sorted at once.  The tie
    break ``order`` is a whole number; a row without a time has no place in the order and is
    left out."""
    ship_package(reqs.sparkSession)
    w = F.lit(1) if weight is None else F.col(weight)
    d = (reqs.where(F.col(ts).isNotNull()).withColumn("event_time", F.col(ts).cast("timestamp"))
             .withWatermark("event_time", delay)
             .select(key, F.col(order).cast("bigint").alias(order), "event_time", F.unix_micros("event_time").alias("at_us"),
                     w.cast("bigint").alias("asked")))      # pandas frames rename columns that start with an underscore
    out = T.StructType([T.StructField(order, T.LongType()), T.StructField(key, T.StringType()),
                        *[T.StructField(c, t) for c, t in limiter.extra]])
    return d.groupBy(key).transformWithStateInPandas(OrderedLimiter(limiter, key, order, bin_ms), out, "append", "EventTime")
