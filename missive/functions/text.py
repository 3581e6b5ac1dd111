"""String column expressions with the reference's text semantics (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space = ASCII blanks \t \n \v \f \r space, NEL (U+0085)
# and the separator categories (Zs, Zl, Zp).
WHITE_SPACE_CLASS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
_TRIM_RE = rf"^{WHITE_SPACE_CLASS}+|{WHITE_SPACE_CLASS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as characters (U+0009-U+000D, U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WHITE_SPACE_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                     + "\u2028\u2029\u202f\u205f\u3000")


def utrim(c) -> Column:
    """Trim Unicode white space at both ends: ``trim`` with the explicit character set
    (no regex, so whole texts cost one pass at each end)."""
    return F.trim(_c(c), F.lit(WHITE_SPACE_CHARS))


def ulower(c) -> Column:
    """Lower-case; dotted capital I becomes a plain ``i`` as in the reference."""
    return F.lower(F.translate(_c(c), "İ", "i"))


def byte_len(c) -> Column:
    """Length in UTF-8 bytes (limits are byte limits)."""
    return F.octet_length(_c(c))


def normalize_request(df, cols=("idempotency_key", "recipient", "channel", "content", "priority")):
    """Trim the five request strings, lower-case channel and priority; null -> ''."""
    out = df
    for name in cols:
        v = utrim(F.coalesce(F.col(name), F.lit("")))
        if name in ("channel", "priority"):
            v = ulower(v)
        out = out.withColumn(name, v)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body(v)``.

    Projections share common subexpressions, filters do not: a predicate pushed into a
    scan would re-evaluate (re-parse, re-trim) the value at each reference.  Binding it
    as the variable of a one-element ``transform`` evaluates it once in every context.
    """
    return F.transform(F.array(value), body)[0]
