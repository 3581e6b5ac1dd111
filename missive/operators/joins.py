"""Joins (J1-J6) and de-duplication.

Interval and as-of joins are written as a union + running window inside time buckets,
so no pair of rows is ever formed and a hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The cancel flag lives 24 hours.
CANCEL_TTL_SECONDS = 24 * 3600
PAYLOAD_FIELDS = ("id", "correlation_id", "recipient", "channel", "content", "priority")


def _micros(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(x.cast("timestamp"))


def bucket_of(c, width_seconds: int) -> Column:
    return F.floor(_micros(c) / F.lit(width_seconds * 1_000_000)).cast("bigint")


def latest_before(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str,
                  width_seconds: int, value: str = "_rt") -> DataFrame:
    """For each left row: the latest right time ``<= left time`` that is newer than
    ``width_seconds`` (else null), per key.

    Each right row is copied into its own bucket and the next one; within a (key,
    bucket) partition a running ``max`` over time gives the answer exactly.  Work is
    linear, and a hot key is split over its time buckets.
    """
    r = right.select(F.col(key).alias("_k"), F.col(rt).alias("_t"))
    rb = bucket_of("_t", width_seconds)
    r = r.select("_k", "_t", F.explode(F.array(rb, rb + 1)).alias("_b"),
                 F.lit(0).alias("_kind"))
    cols = left.columns
    l_ = left.select(*cols, F.col(key).alias("_k"), F.col(lt).alias("_t"),
                     bucket_of(lt, width_seconds).alias("_b"), F.lit(1).alias("_kind"))
    r = r.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols],
                 "_k", "_t", "_b", "_kind")
    u = l_.unionByName(r)
    w = (Window.partitionBy("_k", "_b").orderBy("_t", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max(F.when(F.col("_kind") == 0, F.col("_t"))).over(w)
    fresh = F.when(_micros("_t") - _micros(last) < width_seconds * 1_000_000, last)
    return u.withColumn(value, fresh).where(F.col("_kind") == 1).select(*cols, value)


def any_before(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str,
               width_seconds: int, out: str = "_any") -> DataFrame:
    """For each left row: is there a right time ``<= left time`` newer than ``width_seconds``, per key?

    In the left row's own bucket any right time up to it is new enough, so the earliest decides;
    in the bucket before, all lie before it, so the latest decides.  Both come from one
    aggregate per (key, bucket), which meets a left row at most once, so no pair is formed.
    """
    us, b = width_seconds * 1_000_000, bucket_of(rt, width_seconds)
    r = right.where(F.col(rt).isNotNull()).select(F.col(key).alias("_k"), _micros(rt).alias("_t"), F.explode(F.array(b, b + 1)).alias("_b"), b.alias("_own"))
    own = F.col("_b") == F.col("_own")
    near = r.groupBy("_k", "_b").agg(F.min(F.when(own, F.col("_t"))).alias("_lo"), F.max(F.when(~own, F.col("_t"))).alias("_hi"))
    t = _micros(lt)
    hit = F.coalesce(F.col("_lo") <= t, F.lit(False)) | F.coalesce(t - F.col("_hi") < us, F.lit(False))
    # plain equalities: the aggregate's partitioning serves the join
    j = left.withColumn("_lb", bucket_of(lt, width_seconds)).join(near, (F.col(key) == F.col("_k")) & (F.col("_lb") == F.col("_b")), "left")
    return j.select(*left.columns, hit.alias(out))


def cancel_flag_join(msgs: DataFrame, cancels: DataFrame, key: str = "id", ts: str = "ts",
                     cancel_ts: str = "cancel_ts", ttl_seconds: int = CANCEL_TTL_SECONDS) -> DataFrame:
    """Drop messages whose id carries a live cancel flag (cancel_ts <= ts < cancel_ts+ttl)."""
    m = latest_before(msgs, cancels, key, ts, cancel_ts, ttl_seconds, "_flag")
    return m.where(F.col("_flag").isNull()).drop("_flag")


def dedup_against_existing(new: DataFrame, existing: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """New rows whose key is not already taken (left anti join)."""
    return new.join(existing.select(key), on=key, how="left_anti")


def status_lookup(msgs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Current status per message id; a missing row is its own outcome."""
    j = msgs.join(snapshot.select("id", "status"), "id", "left")
    return j.withColumn("status", F.coalesce(F.col("status"), F.lit("missing")))


def remove_sent(outbox: DataFrame, sent_ids: DataFrame) -> DataFrame:
    """Outbox minus processed ids."""
    return outbox.join(sent_ids.select("id"), "id", "left_anti")


# ----------------------------------------------------------------------- de-duplication
def dedup_in_batch(reqs: DataFrame, key: str = "idempotency_key", order: str = "seq",
                   batch: str = "batch_no") -> DataFrame:
    """First arrival per key wins; a key repeated inside a batch refuses the batch.

    Both facts come from aggregates (``min`` per key, ``count`` per (batch, key)) that
    combine map-side, so a key holding a third of all rows costs no single-task sort.
    """
    first = reqs.groupBy(key).agg(F.min(order).alias("first_seq"))
    inner = (reqs.groupBy(batch, key).agg(F.count(F.lit(1)).alias("_n"))
                 .where(F.col("_n") > 1).select(batch).distinct()
                 .withColumn("batch_has_dup", F.lit(True)))
    j = reqs.join(first, key, "left").join(inner, batch, "left")
    return j.select(order, batch, key, "first_seq",
                    (F.col(order) > F.col("first_seq")).alias("is_dup"),
                    F.coalesce(F.col("batch_has_dup"), F.lit(False)).alias("batch_has_dup"))


# an object of these fields alone, texts or nulls, told by one look at its schema; every other
# object has its fields' types read one by one
_FIELD = f"(?:{'|'.join(PAYLOAD_FIELDS)}): (?:STRING|VOID)"
_PLAIN_PAYLOAD = f"^OBJECT<(?:{_FIELD}(?:, {_FIELD})*)?>$"


def _poison_of(v: Column) -> Column:
    sch = F.schema_of_variant(v)
    wrong = None
    for f in PAYLOAD_FIELDS:
        t = F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant"))
        bad = F.coalesce(~t.isin("STRING", "VOID"), F.lit(False))
        wrong = bad if wrong is None else (wrong | bad)
    return (F.when(v.isNull(), True).when(sch == "VOID", False)
            .when(~sch.startswith("OBJECT"), True).when(sch.rlike(_PLAIN_PAYLOAD), False).otherwise(wrong))


def _in_array(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _alone(text: Column, inside: Column) -> Column:
    """``inside``, the text parsed in an array, if it holds one value at most and the text did not close it."""
    as_member = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    # counted: a path to a missing second element ends in an exception, row by row
    one = F.when(F.coalesce(F.size(F.try_variant_get(inside, "$", "array<variant>")) <= 1, F.lit(True)), inside)
    return F.when(~F.contains(text, F.lit("]")) | as_member.isNotNull(), one)


def strict_json(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else (null otherwise).

    The parser itself stops after the first value; inside an array, text after it breaks
    the array or adds elements.  Only a text that holds a closing bracket could close the
    array itself, and is parsed inside an object as well.
    """
    return F.try_variant_get(_alone(text, _in_array(text)), "$[0]", "variant")


def parse_payload(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """D3 + decode: adds ``poison`` and the named string fields ({column: field}) in place of
    ``payload``, '' when absent or null (a JSON ``null`` payload decodes to empty).

    The parse and its value are columns of their own: an expression that several others read
    stays below them, so each text is parsed once.  Inside a filter use ``poison_payload``."""
    keep = [c for c in df.columns if c != payload]
    v = df.select(*keep, F.col(payload).alias("_text"), _in_array(F.col(payload)).alias("_in"))
    v = v.select(*keep, _alone(F.col("_text"), F.col("_in")).alias("_one"))
    get = lambda f: F.coalesce(F.try_variant_get("_one", f"$[0].{f}", "string"), F.lit(""))
    plain = F.schema_of_variant("_one").rlike(f"^ARRAY<{_PLAIN_PAYLOAD[1:-1]}>$")
    poison = F.when(plain, False).otherwise(_poison_of(F.try_variant_get("_one", "$[0]", "variant")))
    return v.select(*keep, poison.alias("poison"), *[get(f).alias(c) for c, f in fields.items()])


def poison_payload(payload: Column) -> Column:
    """D3: true when the payload does not decode to an object of six string fields.

    JSON ``null`` decodes to an empty payload and is not poison.  The payload is parsed
    once (``let``) and each field's type read by path from the parsed value.
    """
    from missive.functions.text import let
    return let(strict_json(payload), _poison_of)
