"""Request validation (P1-P8): one ordered first-failure expression, fully codegen-ed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.text import byte_len, let, normalize_request

# Limits and the phone pattern of the reference's validation.
MAX_CONTENT_BYTES = 2048
MAX_KEY_BYTES = 255
SMS_MAX_BYTES = 160
EMAIL_MAX_BYTES = 2048
PUSH_MAX_BYTES = 512
PHONE_RE = r"^\+?[1-9][0-9]{7,14}\z"
CHANNELS = ("sms", "email", "push")
PRIORITIES = ("low", "normal", "high")

# Error codes in evaluation order (first match wins).
ERROR_CODES = ("recipient_required", "content_required", "content_too_large",
               "key_required", "key_too_long", "sms_too_long", "sms_phone_format",
               "email_too_long", "email_address_format", "push_too_long",
               "invalid_channel", "invalid_priority")


def first_error(recipient: Column, content: Column, key: Column, channel: Column,
                priority: Column) -> Column:
    """Ordered first failure over already-normalised columns; null when valid."""
    clen = byte_len(content)
    return (F.when(recipient == "", "recipient_required")
            .when(content == "", "content_required")
            .when(clen > MAX_CONTENT_BYTES, "content_too_large")
            .when(key == "", "key_required")
            .when(byte_len(key) > MAX_KEY_BYTES, "key_too_long")
            .when((channel == "sms") & (clen > SMS_MAX_BYTES), "sms_too_long")
            .when((channel == "sms") & ~recipient.rlike(PHONE_RE), "sms_phone_format")
            .when((channel == "email") & (clen > EMAIL_MAX_BYTES), "email_too_long")
            .when((channel == "email") & ~recipient.contains("@"), "email_address_format")
            .when((channel == "push") & (clen > PUSH_MAX_BYTES), "push_too_long")
            .when(~channel.isin(*CHANNELS), "invalid_channel")
            .when(~priority.isin("", *PRIORITIES), "invalid_priority"))


def validate_requests(df: DataFrame) -> DataFrame:
    """P1+P5+P6: normalise, attach ``error`` (null = valid) and default the priority."""
    n = normalize_request(df)
    # bound once: a filter on ``error`` would otherwise re-normalise at each reference
    fields = F.struct("recipient", "content", "idempotency_key", "channel", "priority")
    err = let(fields, lambda s: first_error(s["recipient"], s["content"], s["idempotency_key"],
                                            s["channel"], s["priority"]))
    return (n.withColumn("error", err)
             .withColumn("priority", F.when(F.col("priority") == "", "normal")
                         .otherwise(F.col("priority"))))


def required_fields(df: DataFrame) -> DataFrame:
    """Which of the three required fields are empty after trimming."""
    n = normalize_request(df)
    return n.select("seq", (F.col("recipient") == "").alias("recipient_missing"),
                    (F.col("content") == "").alias("content_missing"),
                    (F.col("idempotency_key") == "").alias("key_missing"))


def content_byte_limit(df: DataFrame) -> DataFrame:
    """Byte (not character) limits on content and key."""
    n = normalize_request(df)
    return n.select("seq", byte_len("content").alias("content_bytes"),
                    F.length("content").alias("content_chars"),
                    (byte_len("content") > MAX_CONTENT_BYTES).alias("content_over"),
                    (byte_len("idempotency_key") > MAX_KEY_BYTES).alias("key_over"))


def channel_rules(df: DataFrame) -> DataFrame:
    """The channel-specific verdict alone (length before format)."""
    n = normalize_request(df)
    ch, clen, rcp = F.col("channel"), byte_len("content"), F.col("recipient")
    verdict = (F.when(ch == "sms", F.when(clen > SMS_MAX_BYTES, "sms_too_long")
                      .when(~rcp.rlike(PHONE_RE), "sms_phone_format"))
               .when(ch == "email", F.when(clen > EMAIL_MAX_BYTES, "email_too_long")
                     .when(~rcp.contains("@"), "email_address_format"))
               .when(ch == "push", F.when(clen > PUSH_MAX_BYTES, "push_too_long"))
               .otherwise("invalid_channel"))
    return n.select("seq", "channel", verdict.alias("channel_error"))


def priority_default(df: DataFrame) -> DataFrame:
    """P5: '' -> normal, outside the set -> invalid."""
    n = normalize_request(df)
    p = F.col("priority")
    return n.select("seq", F.when(p == "", "normal").when(p.isin(*PRIORITIES), p)
                    .alias("priority"), (~p.isin("", *PRIORITIES)).alias("priority_invalid"))


def validity_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason) from one validated frame."""
    v = validate_requests(df)
    return v.where(F.col("error").isNull()).drop("error"), v.where(F.col("error").isNotNull())


def batch_first_invalid(df: DataFrame, batch_col: str = "batch_no",
                        order_col: str = "seq") -> DataFrame:
    """Per batch, 1-based row number and reason of its first invalid row.

    Row numbers come from a window partitioned by batch (batches are <= 1000 rows, so
    the partition is bounded); the per-batch ``min_by`` is a partial/final aggregate.
    """
    w = Window.partitionBy(batch_col).orderBy(order_col)
    v = validate_requests(df).withColumn("row_no", F.row_number().over(w).cast("bigint"))
    bad = v.where(F.col("error").isNotNull())
    first = F.min_by(F.struct("row_no", "error"), F.col("row_no"))
    return (bad.groupBy(batch_col).agg(first.alias("f"))
               .select(batch_col, F.col("f.row_no").alias("row_no"), F.col("f.error").alias("error")))
