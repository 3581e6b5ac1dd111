"""Strict JSON request decoding (S1, S2): VARIANT parse, key and type checks.

A plain ``from_json`` into fields would accept unknown ones and cast 5 to "5"; the
reference's decoder refuses both, so bodies are parsed to variants, whose keys and value
types are checked.  Everything stays in JVM expressions (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.text import let

# The five request fields.
REQUEST_FIELDS = ("idempotency_key", "recipient", "channel", "content", "priority")
MAX_BATCH = 1000
MAX_BODY, MAX_BATCH_BODY = 512 * 1024, 1024 * 1024


def _entries(m: Column, name: str) -> Column:
    """Values under ``name`` in the order of the text; the decoder ignores key case and
    takes repeated keys one after the other."""
    return F.transform(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name), lambda e: e["value"])


def _no_text(v: Column) -> Column:
    return ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID")


def _last_text(values: Column) -> Column:
    """The last string wins; a JSON null leaves what was there."""
    texts = F.filter(values, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "STRING")
    return F.coalesce(F.variant_get(F.try_element_at(texts, F.lit(-1)), "$", "string"), F.lit(""))


def _no_field(key: Column) -> Column:
    return ~F.lower(key).isin(*REQUEST_FIELDS)


def _bad_item(m: Column) -> Column:
    """An item is refused for an unknown key or a value that is neither string nor null; a
    null item decodes to an empty request."""
    return F.coalesce(F.exists(F.map_entries(m), lambda e: _no_field(e["key"]) | _no_text(e["value"])), F.lit(False))


# A body whose keys are spelled plainly, each once, with texts or nulls: its fields are read by
# path from the one parse.  Everything else takes the careful way through maps.
_FIELD = f"(?:{'|'.join(sorted(REQUEST_FIELDS))}): (?:STRING|VOID)"
_PLAIN_OBJECT = f"OBJECT<(?:{_FIELD}(?:, {_FIELD})*)?>"
_FIELDS_TYPE = "struct<" + ",".join(f"{f}:string" for f in REQUEST_FIELDS) + ">"


def _careful(m: Column) -> Column:
    """The five fields of an object read as a map in the order of the text."""
    return F.struct(*[_last_text(_entries(m, f)).alias(f) for f in REQUEST_FIELDS])


def _plain(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(f"^{pattern}$"), F.lit(False))


def _once(df: DataFrame, keep: list[str], result: Column) -> DataFrame:
    """``keep`` and the fields of the struct ``result``, evaluated once per row: a filter on
    them is not pushed below the generator, where it would parse again.  The result is a column
    before the generator, which evaluates its argument without generated code."""
    return df.select(*keep, result.alias("_r")).select(*keep, F.explode(F.array("_r")).alias("_r")).select(*keep, "_r.*")


def parse_requests(df: DataFrame, col: str) -> DataFrame:
    """One body -> error (null = accepted) and the five string fields.

    A body over 512 KiB is refused.  The body is parsed once; only one that is not plain
    (unknown, repeated or oddly spelled keys, other types, broken text) is read again as a
    map in the order of the text (``from_json`` keeps repeated keys).
    """
    keep = [c for c in df.columns if c != col]
    body = F.col("_body")
    x = df.select(*keep, F.col(col).alias("_body"), F.when(F.octet_length(col) <= MAX_BODY, F.try_parse_json(col)).alias("_v"))

    def careful(m: Column) -> Column:
        # every key is one of the fields where the types are looked at
        err = (F.when(m.isNull() & F.col("_v").isNull(), "malformed_json").when(m.isNull(), "not_an_object")
               .when(F.exists(F.map_keys(m), _no_field), "unknown_field").when(F.exists(F.map_values(m), _no_text), "wrong_type"))
        return let(err, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), _careful(m)).alias("f")))

    none = F.lit(None).cast(_FIELDS_TYPE)
    res = (F.when(F.octet_length(body) > MAX_BODY, F.struct(F.lit("body_too_large").alias("error"), none.alias("f")))
           .when(body == "", F.struct(F.lit("empty_body").alias("error"), none.alias("f")))
           .when(_plain(F.col("_v"), _PLAIN_OBJECT), F.struct(F.lit(None).cast("string").alias("error"),
                                                              F.try_variant_get("_v", "$", _FIELDS_TYPE).alias("f")))
           .otherwise(let(F.from_json(body, "map<string,variant>"), careful)))
    r = _once(x, keep, res)
    return r.select(*keep, "error", *[F.coalesce(F.col(f"f.{f}"), F.lit("")).alias(f) for f in REQUEST_FIELDS])


def parse_batches(df: DataFrame, col: str, batch_col: str) -> tuple[DataFrame, DataFrame]:
    """A JSON array body per batch -> (accepted rows with 1-based row_no, rejections).

    A body over 1 MiB is refused; size 1..1000, and every item strict as in S1, else the
    whole batch is refused.  The explode is per batch row and bounded by the 1000-item rule.
    """
    body = F.col("_body")
    x = df.select(batch_col, F.col(col).alias("_body"), F.when(F.octet_length(col) <= MAX_BATCH_BODY, F.try_parse_json(col)).alias("_v"))
    kind = f"array<{_FIELDS_TYPE}>"

    def sized(n: Column) -> Column:
        return F.when(n == 0, "empty_batch").when(n > MAX_BATCH, "batch_too_large")

    def result(error: Column, items: Column) -> Column:
        return F.struct(error.alias("error"), items.alias("items"))

    def careful(items: Column) -> Column:
        # the elements are taken apart only where the maps cannot tell how many they are
        n = F.coalesce(F.size(items), F.size(F.try_variant_get("_v", "$", "array<variant>")))
        err = let(n, lambda k: F.when(items.isNull() & F.col("_v").isNull(), "malformed_json").when(k.isNull(), "not_an_array")
                  .otherwise(F.coalesce(sized(k), F.when(items.isNull(), "bad_item").when(F.exists(items, _bad_item), "bad_item"))))
        return let(err, lambda e: result(e, F.when(e.isNull(), F.transform(items, _careful))))

    plain = F.try_variant_get("_v", "$", kind)
    res = (F.when(F.octet_length(body) > MAX_BATCH_BODY, result(F.lit("body_too_large"), F.lit(None).cast(kind)))
           .when(_plain(F.col("_v"), f"ARRAY<(?:{_PLAIN_OBJECT}|VOID)>"), result(sized(F.size(plain)), plain))
           # an unparsable value inside the array leaves it to the map reading alone
           .otherwise(let(F.when(F.col("_v").isNull() | F.schema_of_variant("_v").startswith("ARRAY<"),
                                 F.from_json(body, "array<map<string,variant>>")), careful)))
    checked = _once(x, [batch_col], res)
    rejected = checked.where(F.col("error").isNotNull()).select(batch_col, "error")
    rows = checked.where(F.col("error").isNull()).select(batch_col, F.posexplode("items").alias("_pos", "_item"))
    rows = rows.select(batch_col, (F.col("_pos") + 1).cast("bigint").alias("row_no"),
                       *[F.coalesce(F.col(f"_item.{f}"), F.lit("")).alias(f) for f in REQUEST_FIELDS])
    return rows, rejected
