"""What the API does with its calls, as one pipeline: decode, validate, quota, commit.

A single request is decoded strictly and validated before it spends one token; a batch is
decoded strictly, spends one token per item, and only then are its items validated.  Calls
that decoding (or, for singles, validation) refuses spend nothing.  Both kinds share one
bucket per client address.  A call commits if none of its keys is taken by the table, by an
earlier committed call, or twice by itself (D2).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators import ingest
from missive.operators import validate as V
from missive.operators.admission import batch_atomic_admission
from missive.operators.token_bucket import limit_token_bucket
from missive.session import materialize

# The API's bucket (burst, tokens a second) and its key prefix.
CAPACITY, RATE = 1000, 100
KEY_PREFIX = "api_tokens:"


@dataclass
class ApiCalls:
    calls: DataFrame        # call_id, key, ts, weight: every call that reaches the bucket
    rows: DataFrame         # call_id, row_no and the five fields of these calls, normalised, with error


def decode_calls(singles: DataFrame, batches: DataFrame, ip: Column) -> ApiCalls:
    """``singles``: seq, arrival_ts, body and what ``ip`` reads; ``batches``: batch_no,
    arrival_ts, body and what ``ip`` reads."""
    fields = list(ingest.REQUEST_FIELDS)
    key = F.concat(F.lit(KEY_PREFIX), ip)
    one = singles.withColumns({"call_id": F.concat(F.lit("s-"), F.col("seq").cast("string")), "key": key})
    one = ingest.parse_requests(one.select("call_id", "key", F.col("arrival_ts").alias("ts"), "body"), "body")
    one = V.validate_requests(one.where("error IS NULL").drop("error"))
    one = materialize(one, "api_singles").where("error IS NULL")     # every body is parsed once
    one_calls = one.select("call_id", "key", "ts", F.lit(1).alias("weight"))
    one_rows = one.select("call_id", F.lit(1).cast("bigint").alias("row_no"), *fields, "error")
    many, _rejected = ingest.parse_batches(batches, "body", "batch_no")
    many = V.validate_requests(many.withColumn("call_id", F.concat(F.lit("b-"), F.col("batch_no").cast("string"))))
    many = materialize(many, "api_items")
    rows = one_rows.unionByName(many.select(one_rows.columns))
    size = many.groupBy("batch_no").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    many_calls = batches.select("batch_no", key.alias("key"), F.col("arrival_ts").alias("ts")).join(size, "batch_no").select(
        F.concat(F.lit("b-"), F.col("batch_no").cast("string")).alias("call_id"), "key", "ts", "weight")
    return ApiCalls(materialize(one_calls.unionByName(many_calls), "api_calls"), rows)


def quota(calls: DataFrame, capacity: float = CAPACITY, rate: float = RATE) -> DataFrame:
    """L4: every call's verdict on its client's bucket."""
    return limit_token_bucket(calls, "key", "ts", "call_id", "weight", capacity, rate)


def committed(api: ApiCalls, verdicts: DataFrame, existing_keys: DataFrame) -> DataFrame:
    """call_id, ts, weight of the calls that pass quota, validation and the key check."""
    passed = verdicts.where("allowed").select("call_id", "ts", "weight")
    invalid = api.rows.where("error IS NOT NULL").select("call_id").distinct()
    passed = passed.join(invalid, "call_id", "left_anti")
    members = api.rows.join(passed, "call_id").select("call_id", F.col("idempotency_key").alias("key"),
                                                       F.struct("ts", "call_id").alias("at"))
    members = materialize(members, "commit_members")       # read by the key check and by the rounds' start
    taken = members.join(existing_keys.select(F.col("idempotency_key").alias("key")), "key", "left_semi").select("call_id")
    verdict = batch_atomic_admission(members, "call_id", "key", "at", refused_upfront=taken)
    return passed.join(verdict.where("admitted").select("call_id"), "call_id", "left_semi")
