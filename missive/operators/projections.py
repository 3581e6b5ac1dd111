"""Row-wise projections (P15, P17, P22-P27): all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.text import utrim
from missive.sources.derived import uuid_from
from missive.sources.tables import read_table

# Accepted UUID spellings (canonical, urn:uuid: prefix, braces, 32 hex).
_H = "[0-9a-f]"
_CANON = f"{_H}{{8}}-{_H}{{4}}-{_H}{{4}}-{_H}{{4}}-{_H}{{12}}"
UUID_RE = rf"(?i)^(urn:uuid:)?{_CANON}\z|^\{{{_CANON}\}}\z|^{_H}{{32}}\z"

# Topic names per priority.
TOPIC_HIGH, TOPIC_NORMAL, TOPIC_LOW = "notifications-high", "notifications-normal", "notifications-low"

PAYLOAD_FIELDS = ("id", "correlation_id", "recipient", "channel", "content", "priority")


def uuid_canonical(c: Column) -> Column:
    """Canonical lower-case text of an accepted spelling, null when not a UUID."""
    h = F.lower(F.regexp_replace(F.regexp_replace(c, "(?i)^urn:uuid:", ""), "[-{}]", ""))
    canon = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                        F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(c.rlike(UUID_RE), canon)


def uuid_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 over every order id written in one of the accepted (or a broken) spelling."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    u = uuid_from(F.col("k"))
    k6 = F.col("k") % 6
    spelled = (F.when(k6 == 0, u).when(k6 == 1, F.upper(u))
               .when(k6 == 2, F.concat(F.lit("urn:uuid:"), u))
               .when(k6 == 3, F.concat(F.lit("{"), u, F.lit("}")))
               .when(k6 == 4, F.regexp_replace(u, "-", ""))
               .otherwise(F.concat(u, F.lit("z"))))
    x = o.select("k", spelled.alias("input"))
    return x.select("k", "input", F.col("input").rlike(UUID_RE).alias("ok"),
                    uuid_canonical(F.col("input")).alias("canonical"))


def limit_clamp(c: Column) -> Column:
    """An integer text in 1..100, else 10."""
    n = F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))
    return F.when(n.between(1, 100), n.cast("int")).otherwise(F.lit(10))


def limit_clamp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    raw = (F.when(eid % 17 == 0, "abc").when(eid % 19 == 0, "")
           .when(eid % 23 == 0, F.concat(F.lit("00000000"), (eid % 130).cast("string")))
           .when(eid % 29 == 0, F.concat((eid % 130).cast("string"), F.lit("00000000000000000000")))
           .otherwise((eid % 130 - 10).cast("string")))
    return e.select(eid.alias("seq"), raw.alias("raw")).select(
        "seq", "raw", limit_clamp(F.col("raw")).alias("limit"))


def classify_http(c) -> Column:
    """Transport error (null), 5xx, 429, 408 -> retriable; 2xx -> delivered; else permanent."""
    s = F.col(c) if isinstance(c, str) else c
    return (F.when(s.isNull() | (s >= 500) | s.isin(429, 408), "retriable")
            .when(s.between(200, 299), "delivered").otherwise("permanent"))


def route_priority(c) -> Column:
    """Exact, case-sensitive priority -> topic; anything else -> normal."""
    p = F.col(c) if isinstance(c, str) else c
    return (F.when(p == "high", TOPIC_HIGH).when(p == "low", TOPIC_LOW)
            .otherwise(TOPIC_NORMAL))


def payload_json(keep_nulls: bool = True) -> Column:
    """Notification -> message payload JSON (null correlation_id kept as null)."""
    opts = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*PAYLOAD_FIELDS), opts)


def webhook_body() -> Column:
    """{to, channel, content}."""
    return F.to_json(F.struct(F.col("recipient").alias("to"), "channel", "content"))


def client_ip(xff: Column, remote: Column) -> Column:
    """P25: first X-Forwarded-For entry, else host of host:port ('' when no port)."""
    bracket = remote.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*\z")
    plain = remote.rlike(r"^[^:\[\]]*:[^:\[\]]*\z")
    host = (F.when(bracket, F.regexp_extract(remote, r"^\[([^\[\]]*)\]:", 1))
            .when(plain, F.regexp_extract(remote, r"^([^:]*):", 1)).otherwise(F.lit("")))
    first = F.split(xff, ",").getItem(0)
    return utrim(F.when(xff != "", first).otherwise(host))


def client_ip_table(requests: DataFrame) -> DataFrame:
    seq = F.col("seq")
    x = requests.select(
        "seq", F.when(seq % 3 == 0, F.lit("")).otherwise(F.col("xff")).alias("xff"),
        F.when(seq % 5 == 0, F.lit("10.1.1.1")).otherwise(F.concat(
            F.lit("192.168.1."), (seq % 250).cast("string"), F.lit(":"),
            (1000 + seq % 1000).cast("string"))).alias("remote"))
    return x.select("seq", client_ip(F.col("xff"), F.col("remote")).alias("client_ip"))


def correlation_id(c) -> Column:
    """The given request id, else a fresh UUID."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(x, F.lit("")), F.expr("uuid()"))
