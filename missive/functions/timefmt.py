"""Time text helpers: RFC 3339 format/parse, date-only parameters, list cursors."""

from __future__ import annotations

import base64
import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text shapes.
RFC3339_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})\z"
DATE_ONLY_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_RFC3339_PY = re.compile(RFC3339_RE.replace(r"\z", r"\Z"))
_DATE_PY = re.compile(DATE_ONLY_RE.replace(r"\z", r"\Z"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc3339_nano(ts) -> Column:
    """Format a UTC wall-clock timestamp as RFC3339Nano (fraction trailing zeros cut)."""
    t = _c(ts)
    micros = F.unix_micros(t.cast("timestamp")) % 1000000
    frac = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("Z"))


def rfc3339_parse(c) -> Column:
    """RFC 3339 text -> UTC wall-clock TIMESTAMP_NTZ; null when the text is not RFC 3339."""
    x = _c(c)
    ts = F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"))
    return F.when(x.rlike(RFC3339_RE), ts.cast("timestamp_ntz"))


def date_param(c, end_of_day: bool = False) -> Column:
    """Column form of the date parameter parse: date-only or RFC 3339 -> TIMESTAMP_NTZ.

    With ``end_of_day`` a date-only value becomes the next midnight (exclusive bound);
    an RFC 3339 value is returned as is (inclusive bound).
    """
    x = _c(c)
    day = F.to_timestamp_ntz(x, F.lit("yyyy-MM-dd"))
    if end_of_day:
        day = day + F.expr("INTERVAL 1 DAY")
    return F.when(x.rlike(DATE_ONLY_RE), day).otherwise(rfc3339_parse(x))


def encode_cursor(created_at, id_) -> Column:
    """O2: base64 of ``<RFC3339Nano>|<id>``."""
    return F.base64(F.encode(F.concat_ws("|", rfc3339_nano(created_at), _c(id_)), "UTF-8"))


def decode_cursor(c) -> Column:
    """O3: struct(ok, cursor_time, cursor_id); not ok for bad base64, not two parts,
    bad time or empty id."""
    raw = F.try_to_binary(_c(c), F.lit("base64"))
    txt = F.expr("cast(null as string)") if raw is None else raw.cast("string")
    parts = F.split(txt, r"\|", -1)
    two = F.coalesce(F.size(parts) == 2, F.lit(False))
    t = F.when(two, rfc3339_parse(F.element_at(parts, 1)))
    i = F.when(two, F.element_at(parts, 2))
    ok = t.isNotNull() & F.coalesce(i != "", F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, t).alias("cursor_time"), F.when(ok, i).alias("cursor_id"))


# ----------------------------------------------------------------- driver-side parameters
def parse_date_param(text: str, end_of_day: bool = False):
    """P11/P16 parameter parse: RFC 3339 or YYYY-MM-DD.

    Returns (bound, inclusive) as UTC wall-clock ``datetime``.  A date-only end bound
    covers the whole day, expressed exactly as an exclusive bound at the next midnight.
    Raises ``ValueError`` for anything else (e.g. ``2026-03`` or a bare time).
    """
    if _DATE_PY.match(text):
        d = _dt.datetime.strptime(text, "%Y-%m-%d")
        if end_of_day:
            return d + _dt.timedelta(days=1), False
        return d, True
    if _RFC3339_PY.match(text):
        t = text.replace("Z", "+00:00")
        m = re.match(r"^(.*T\d{2}:\d{2}:\d{2})(\.\d+)?(.*)$", t)
        frac = (m.group(2) or "")[:7].ljust(7, "0") if m.group(2) else ""
        d = _dt.datetime.fromisoformat(m.group(1) + frac + m.group(3))
        return d.astimezone(_dt.timezone.utc).replace(tzinfo=None), True
    raise ValueError(f"not an RFC 3339 time or date: {text!r}")


def check_date_range(start: str | None, end: str | None) -> None:
    """Refuse start > end (end widened to its day's end when date-only)."""
    if start and end:
        s, _ = parse_date_param(start)
        e, inclusive = parse_date_param(end, end_of_day=True)
        last = e if inclusive else e - _dt.timedelta(microseconds=1)
        if s > last:
            raise ValueError("start_date after end_date")


def encode_cursor_py(created_at: _dt.datetime, id_: str) -> str:
    frac = f".{created_at.microsecond:06d}".rstrip("0") if created_at.microsecond else ""
    txt = created_at.strftime("%Y-%m-%dT%H:%M:%S") + frac + "Z|" + id_
    return base64.b64encode(txt.encode()).decode()


def decode_cursor_py(cursor: str):
    """Driver-side decode of one cursor parameter -> (time, id); ValueError if invalid."""
    try:
        txt = base64.b64decode(cursor, validate=True).decode()
    except Exception as exc:  # noqa: BLE001
        raise ValueError("invalid cursor") from exc
    parts = txt.split("|")
    if len(parts) != 2 or not parts[1]:
        raise ValueError("invalid cursor")
    t, _ = parse_date_param(parts[0]) if _RFC3339_PY.match(parts[0]) else (None, None)
    if t is None:
        raise ValueError("invalid cursor")
    return t, parts[1]


def clamp_limit(text) -> int:
    """P17 parameter form: not a number, <= 0 or > 100 -> 10."""
    t = "" if text is None else str(text)
    n = int(t) if re.fullmatch(r"[+-]?[0-9]+", t) else 0
    return n if 1 <= n <= 100 else 10


def ntz_lit(d: _dt.datetime) -> Column:
    """A wall-clock literal as TIMESTAMP_NTZ (no dependence on the JVM or Python zone)."""
    return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
