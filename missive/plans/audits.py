"""Invariant audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import audit as T
from missive.operators import joins as J
from missive.operators import transitions as M
from missive.plans.joins import OUTCOME_SQL
from missive.plans.registry import query
from missive.sources import derived as D

_LAG = "(SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS prev_status FROM transitions)"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in T.LEGAL_MOVES)


@query("audit_types", """SELECT id, seq, status, retry_count,
  CASE WHEN status NOT IN ('pending', 'processing', 'delivered', 'failed_retrying', 'failed_permanently', 'canceled')
       THEN 'unknown_status' ELSE 'retry_count_out_of_range' END AS reason
FROM transitions WHERE status NOT IN ('pending', 'processing', 'delivered', 'failed_retrying', 'failed_permanently',
  'canceled') OR retry_count < 0 OR retry_count > 3""", ("transitions",))
def audit_types(spark, sf):
    return T.audit_types(D.transitions(spark, sf))


@query("audit_delivered_stable", f"""SELECT id, seq, prev_status, status FROM {_LAG}
  WHERE prev_status = 'delivered' AND status <> 'delivered'""", ("transitions",))
def audit_delivered_stable(spark, sf):
    return T.audit_terminal_stable(D.transitions(spark, sf), "delivered")


@query("audit_failed_stable", f"""SELECT id, seq, prev_status, status FROM {_LAG}
  WHERE prev_status = 'failed_permanently' AND status <> 'failed_permanently'""", ("transitions",))
def audit_failed_stable(spark, sf):
    return T.audit_terminal_stable(D.transitions(spark, sf), "failed_permanently")


@query("audit_legal_moves", f"""SELECT id, seq, prev_status, status FROM {_LAG}
  WHERE (prev_status IS NULL AND status <> 'pending')
     OR (prev_status IS NOT NULL AND prev_status <> status
         AND (prev_status, status) NOT IN (SELECT * FROM (VALUES {_LEGAL})))""", ("transitions",))
def audit_legal_moves(spark, sf):
    return T.audit_legal_moves(D.transitions(spark, sf))


@query("audit_unresolved", """SELECT id, arg_max(status, seq) AS last_status, count(*) AS steps FROM transitions
  GROUP BY id HAVING arg_max(status, seq) NOT IN ('delivered', 'failed_permanently', 'canceled')""", ("transitions",))
def audit_unresolved(spark, sf):
    return T.audit_unresolved(D.transitions(spark, sf))


def _middle(percent: int) -> str:
    """The exact value of nearest rank, then the middle of the slot it falls in."""
    v = f"vs[(len(vs) * {percent} + 99) // 100]"
    s = f"greatest(length(bin({v})) - 8, 0)"
    return f"(({v} >> {s}) << {s}) + (1::BIGINT << {s}) // 2"


@query("resolution_times", f"""SELECT channel, len(vs) AS n, {_middle(50)} AS p50, {_middle(95)} AS p95, {_middle(99)} AS p99 FROM (
  SELECT n.channel, list_sort(list(greatest(epoch_us(o.updated_at) - epoch_us(n.created_at), 0))) AS vs
  FROM ({OUTCOME_SQL}) o JOIN notifications n USING (id)
  WHERE o.old_status <> o.status AND o.status IN ('delivered', 'failed_permanently') GROUP BY n.channel)""", ("notifications", "attempts"))
def resolution_times(spark, sf):
    """T5: how long messages took from creation to a terminal status, per channel, from one
    sketch per channel and day."""
    n = D.notifications(spark, sf).withColumn("old_status", F.col("status"))
    done = (F.col("old_status") != F.col("status")) & F.col("status").isin("delivered", "failed_permanently")
    out = M.apply_outcomes(n, D.attempts(spark, sf), keep=("old_status",)).withColumn("resolved_at", F.when(done, F.col("updated_at")))
    return T.resolution_times(T.resolution_sketches(out))


@query("audit_dlq_complete", f"""SELECT id FROM ({OUTCOME_SQL}) WHERE status = 'failed_permanently' AND NOT dlq""",
       ("notifications", "attempts"))
def audit_dlq_complete(spark, sf):
    applied = M.apply_outcomes(D.notifications(spark, sf), D.attempts(spark, sf))
    return T.audit_dlq_complete(applied, applied.where("dlq"))


@query("audit_outbox_complete", """SELECT id FROM notifications n WHERE status = 'pending' AND NOT EXISTS (
  SELECT 1 FROM outbox o WHERE o.aggregate_id = n.id AND NOT __POISON__)""", ("notifications", "outbox"))
def audit_outbox_complete(spark, sf):
    o = D.outbox(spark, sf)
    return T.audit_outbox_complete(D.notifications(spark, sf), o.where(~J.poison_payload(F.col("payload"))))
