"""Registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import one_row_per_id
from missive.llm.conversation_repair import repair_audit
from missive.llm.language_id import MARKUP_RE, fit_languages, identify, visible_text
from missive.llm.labelled import remainder
from missive.llm.license_scan import NEAR, NOTICE_GRAM, NOTICES, PHRASE_GRAM, PHRASES, SHARE, license_scan
from missive.llm.merkle import tamper_audit
from missive.llm.mixing import mixture
from missive.llm.near_dups import near_duplicates
from missive.llm.packing import pack
from missive.llm.quality_crf import fit_quality, quality
from missive.llm.quality_rules import STOP_WORDS, quality_rules
from missive.llm.substring_dedup import substring_digest
from missive.llm.topk import exact_top_k
from missive.llm.toxicity import fit_toxicity, toxicity
from missive.llm.url_filters import host_of, path_of, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: mixing -------------------------------------------------------------------------

MIX_MAX_EPOCHS = 1.25
MIX_BLOCK = 1 << 20

OP1_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
tot AS (SELECT sum(n_tokens)::BIGINT AS budget FROM counts),
shares AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE / (SELECT budget FROM tot)::DOUBLE AS share
           FROM counts GROUP BY source HAVING sum(n_tokens) > 0),
flat(a, f) AS (SELECT a, max(pow(share, a) / tokens) / sum(pow(share, a)) * (SELECT budget FROM tot) > {MIX_MAX_EPOCHS}
               FROM shares, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(a) GROUP BY a),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN mid ELSE lo END, CASE WHEN f THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(pow(share, (b.lo + b.hi) / 2) / tokens) / sum(pow(share, (b.lo + b.hi) / 2)) * (SELECT budget FROM tot) > {MIX_MAX_EPOCHS}
                FROM shares) AS f
        FROM bis b WHERE i < 30)),
expo AS (SELECT CASE WHEN NOT (SELECT f FROM flat WHERE a = 0) THEN 0.0::DOUBLE WHEN (SELECT f FROM flat WHERE a = 1) THEN 1.0::DOUBLE
                ELSE (SELECT hi FROM bis WHERE i = 30) END AS a),
exact AS (SELECT source, tokens, pow(share, (SELECT a FROM expo)) / (SELECT sum(pow(share, (SELECT a FROM expo))) FROM shares)
                 * (SELECT budget FROM tot)::DOUBLE AS q FROM shares),
plan AS (
  SELECT source, tokens, floor(q)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor((q - floor(q)) * 1e9) DESC, source)
           <= (SELECT budget FROM tot) - sum(floor(q)::BIGINT) OVER () THEN 1 ELSE 0 END AS quota FROM exact),
uses AS (
  SELECT doc_id, c.source, n_tokens, epoch, tokens, quota,
         ('0x' || substr(md5('42|' || epoch || '|' || doc_id), 1, 15))::BIGINT AS key
  FROM counts c JOIN plan p USING (source), generate_series(0, (quota + tokens - 1) // tokens - 1) e(epoch) WHERE n_tokens > 0 AND quota > 0),
placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM uses),
cut AS (SELECT *, (start::HUGEINT * greatest(1, ((SELECT budget FROM tot) + {MIX_BLOCK - 1}) // {MIX_BLOCK}) // quota)::BIGINT AS block
        FROM placed WHERE start < quota)
SELECT doc_id, source, n_tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY key, source, doc_id)::BIGINT AS place FROM cut
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), max_epochs=MIX_MAX_EPOCHS, block_tokens=MIX_BLOCK)


# --- 4: quality rules ------------------------------------------------------------------

_STOP = ", ".join(repr(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(generate_series(1, len(w) - 4)) u(i) WHERE len(w) >= 5),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM rep, generate_series(0, 4) g(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•·]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{Lu}}{{2,}}\\P{{L}}*')))::BIGINT AS n_upper_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        (100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words
         OR 100 * n_stop_words < 4 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_bullet_lines > 90 * n_lines
         OR 100 * n_ellipsis_lines > 30 * n_lines OR 100 * n_upper_words > 50 * n_words) AS rules_failed FROM m)
SELECT *, NOT base_failed AND NOT rules_failed AS kept FROM b
"""


@query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


# --- 10: URL filters -------------------------------------------------------------------

def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date spread over 2024 by the page id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 366) AS INT))").alias("fetched_on"))


def list_entries_of(pages: DataFrame) -> DataFrame:
    """A dated list with one entry per page: its host, its registered domain or the first
    part of its path, listed (two of three) or taken off again."""
    host = host_of(F.col("url"))
    entry = (F.when(F.expr("pmod(page_id, 16) = 0"), F.concat(F.lit("domain:"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)))
             .when(F.expr("pmod(page_id, 16) <= 4"), F.concat(F.lit("host:"), host))
             .otherwise(F.concat(F.lit("prefix:"), host, F.lit("/"), F.regexp_extract(path_of(F.col("url")), r"^/([^/]+)", 1))))
    return pages.select(entry.alias("key"), F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 101 + 11, 366) AS INT))").alias("on_date"),
                        F.expr("pmod(page_id, 3) <> 2").alias("listed"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched_on,
         DATE '2024-01-01' + ((page_id * 101 + 11) % 366)::INT AS on_date, page_id % 3 <> 2 AS listed FROM pages),
e AS (
  SELECT CASE WHEN page_id % 16 = 0 THEN 'domain:' || regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1)
              WHEN page_id % 16 <= 4 THEN 'host:' || host
              ELSE 'prefix:' || host || '/' || regexp_extract(path, '^/([^/]+)', 1) END AS key, on_date, bool_or(listed) AS listed
  FROM p GROUP BY 1, 2),
spans AS (
  SELECT key, on_date AS since, lead(on_date) OVER (PARTITION BY key ORDER BY on_date) AS until, listed FROM (
    SELECT *, coalesce(lag(listed) OVER (PARTITION BY key ORDER BY on_date), false) AS before FROM e) WHERE listed <> before),
seg AS (SELECT page_id, host, fetched_on, string_split(host, '.') AS labels,
               list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
keys AS (
  SELECT page_id, fetched_on, 'host:' || host AS key FROM seg
  UNION SELECT page_id, fetched_on, 'domain:' || array_to_string(labels[i:], '.') FROM seg, unnest(generate_series(1, len(labels))) u(i)
  UNION SELECT page_id, fetched_on, 'prefix:' || host || '/' || array_to_string(parts[:i], '/') FROM seg, unnest(generate_series(1, len(parts))) u(i)),
hit AS (SELECT page_id, count(*) AS n, min({'key': keys.key, 'since': since}) AS f
        FROM keys JOIN spans ON keys.key = spans.key AND listed AND since <= fetched_on AND (until IS NULL OR fetched_on < until) GROUP BY page_id)
SELECT page_id, fetched_on, host, coalesce(n, 0)::BIGINT AS n_active, f.key AS entry, f.since AS since, n IS NULL AS kept FROM p LEFT JOIN hit USING (page_id)
"""


@query("op10_url_filters", OP10_SQL)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(captures_of(pages), list_entries_of(pages))


# --- 6: substring dedup ----------------------------------------------------------------

OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS g FROM d, unnest(generate_series(1, len(w) - 19)) u(i) WHERE len(w) >= 20),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM dup, generate_series(0, 19) g(k) GROUP BY doc_id),
kept AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM (
    SELECT d.doc_id, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) u(i)) v
    ANTI JOIN (SELECT doc_id, unnest(places) AS i FROM gone) g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM kept LEFT JOIN words USING (doc_id)
"""


@query("op6_substring_dedup", OP6_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


# --- 7: near-duplicates ----------------------------------------------------------------

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM d, unnest(generate_series(1, greatest(1, len(w) - 1))) u(i) WHERE len(w) >= 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""


@query("op7_near_dups", OP7_SQL)
def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(one_row_per_id(table(spark, sf_dir, "documents").select("doc_id", "text")), shingle=2)


# --- 2: exact top-k --------------------------------------------------------------------

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op2_exact_topk", OP2_SQL)
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(
        "transform(embedding, x -> CASE WHEN abs(CAST(x AS DOUBLE)) < double('infinity') THEN CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) ELSE CAST(x AS DOUBLE) END)").alias("embedding"))
    out = exact_top_k(vec, F.expr("vec_id % 100 = 0"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


# --- 3: packing ------------------------------------------------------------------------

@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


# --- 8 and 9: toxicity and quality -----------------------------------------------------

def _scored(docs: DataFrame, rem: int, out: int) -> DataFrame:
    held = F.coalesce(remainder("doc_id", rem) == out, F.lit(False))
    return docs.withColumn("held_out", held).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, remainder("doc_id", 4) != 2)
    return _scored(toxicity(docs, model), 4, 2).select("doc_id", "held_out", "score", "predicted", "n_hits", "n_words")


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, remainder("doc_id", 5) != 0)
    return _scored(quality(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted", "line_quality", "n_lines")


# --- 5: language identification --------------------------------------------------------

def _declared(sf_dir=None) -> dict:
    """Evidence a document table carries: its declared language and its source as host."""
    return {"declared": F.col("lang"), "host": F.col("source")}


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs), **_declared())


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with markup language, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    return identify(pages.withColumn("visible", visible_text(F.col("html"))), fit_languages(table(spark, sf_dir, "documents")), "page_id", "visible",
                    declared=F.regexp_extract("html", MARKUP_RE, 1), suffix=F.regexp_extract(host, r"\.([^.]+)$", 1), host=host)


# --- 12: Merkle manifest ---------------------------------------------------------------

def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit (DuckDB has no function for it)."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), "
            "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))")


def _field(v: str) -> str:
    return f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}, '-')"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({" || ".join(_field(c) for c in (
             "doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))}) END AS altered
  FROM documents),
l0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
lev(l, key, idx, n, h) AS (
  SELECT 0, key, idx, n, leaf FROM l0
  UNION ALL
  SELECT l + 1, key, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM lev WHERE n > 1 GROUP BY l, key, idx // 8, n),
subs AS (SELECT key, max(l) AS height, arg_max(h, l) AS subroot FROM lev WHERE n = 1 GROUP BY key),
top(l, idx, n, h) AS (
  SELECT 0, row_number() OVER (ORDER BY key) - 1, count(*) OVER (), subroot FROM subs
  UNION ALL
  SELECT l + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY l, idx // 8, n),
heads AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS place FROM subs),
steps AS (
  SELECT l0.doc_id, l0.key, l0.idx, lev.l AS step, coalesce(string_agg(h, '' ORDER BY lev.idx) FILTER (WHERE lev.idx < l0.idx // pow(8, lev.l)::BIGINT), '') AS a,
         coalesce(string_agg(h, '' ORDER BY lev.idx) FILTER (WHERE lev.idx > l0.idx // pow(8, lev.l)::BIGINT), '') AS b
  FROM l0 JOIN lev ON lev.key = l0.key AND lev.n > 1 AND lev.idx // 8 = l0.idx // pow(8, lev.l + 1)::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l0.doc_id, l0.key, l0.idx, height + 1 + top.l, coalesce(string_agg(h, '' ORDER BY top.idx) FILTER (WHERE top.idx < place // pow(8, top.l)::BIGINT), ''),
         coalesce(string_agg(h, '' ORDER BY top.idx) FILTER (WHERE top.idx > place // pow(8, top.l)::BIGINT), '')
  FROM l0 JOIN heads USING (key) JOIN top ON top.n > 1 AND top.idx // 8 = place // pow(8, top.l + 1)::BIGINT
  GROUP BY l0.doc_id, l0.key, l0.idx, height, top.l, place),
path AS (SELECT key, idx, list({{'a': a, 'b': b}} ORDER BY step) AS p, string_agg(a || b, '' ORDER BY step) AS sib FROM steps GROUP BY key, idx),
climb(key, idx, k, h) AS (
  SELECT key, idx, 1, coalesce(altered, leaf) FROM l0
  UNION ALL
  SELECT c.key, c.idx, k + 1, sha256(p[k].a || h || p[k].b) FROM climb c JOIN path USING (key, idx) WHERE k <= len(p)),
ends AS (SELECT key, idx, arg_max(h, k) AS folded_root FROM climb GROUP BY key, idx)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1 ORDER BY l LIMIT 1) AS root, sha256(coalesce(sib, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top WHERE n = 1 ORDER BY l LIMIT 1) AS verified
FROM l0 JOIN subs USING (key) LEFT JOIN path USING (key, idx) JOIN ends USING (key, idx)
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_audit(table(spark, sf_dir, "documents"))


# --- 13: conversation structure repair -------------------------------------------------

OP13_SQL = f"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
dm AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM x, generate_series(1, CASE WHEN f = 3 THEN 2 ELSE 1 END) g(copy) WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 1), role, text, copy) AS i FROM dm),
r AS (
  SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '-' END AS fault FROM o),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
mv(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
                                  (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
edits(p, q, c, cost, e) AS (
  SELECT p, q, c, 0, 'K' FROM mv UNION ALL SELECT p, q, '*', 2, 'R' FROM mv WHERE c <> 's' UNION ALL SELECT p, p, '*', 3, 'D' FROM range(4) t(p)),
dp(conv_id, i, st, v) AS (
  SELECT conv_id, 0::BIGINT, q, {{'cost': cost::BIGINT, 'audit': edits}} FROM convs, ins WHERE p = 0
  UNION ALL
  SELECT r.conv_id, r.i, n.q, min({{'cost': dp.v.cost + e.cost + n.cost + CASE WHEN r.fault = 'truncated' AND e.e <> 'D' THEN 1 ELSE 0 END,
                                    'audit': dp.v.audit || e.e || n.edits}})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
  JOIN edits e ON e.p = dp.st AND e.c IN ('*', r.c) AND (e.e = 'D' OR r.fault IN ('-', 'truncated'))
  JOIN ins n ON n.p = e.q GROUP BY r.conv_id, r.i, n.q),
fin AS (SELECT c.conv_id, min(dp.v) AS v FROM counts c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n AND dp.st IN (0, 3) GROUP BY c.conv_id),
tok(conv_id, k, i, st, line) AS (
  SELECT conv_id, 0, 0::BIGINT, 0, NULL::VARCHAR FROM fin
  UNION ALL
  SELECT t.conv_id, t.k + 1, t.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
         CASE WHEN e = 'D' THEN t.st WHEN e = 'K' AND r.c = 's' THEN 1 WHEN t.st = 2 THEN 3 ELSE 2 END,
         CASE e WHEN 'D' THEN NULL WHEN 'K' THEN r.role || ':' || r.text
                ELSE CASE WHEN t.st = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN r.text ELSE '' END END
  FROM (SELECT t.*, f.v.audit[t.k + 1] AS e FROM tok t JOIN fin f ON f.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.k < length(f.v.audit)) t
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1),
txt AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS s FROM tok GROUP BY conv_id)
SELECT convs.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(fin.v.cost, 0)::BIGINT AS cost,
       coalesce(fin.v.audit, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM convs LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM convs.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM convs.conv_id LEFT JOIN txt ON txt.conv_id IS NOT DISTINCT FROM convs.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_audit(table(spark, sf_dir, "conversations"))


# --- 11: license scans -----------------------------------------------------------------

_TEMPS = ", ".join(f"({i}, '{a}', string_split('{b}', ' '), {phrase})" for i, (a, b, phrase) in enumerate(
    [(a, b, "true") for a, b in PHRASES] + [(a, b, "false") for a, b in NOTICES]))
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
temps(t, label, tw, phrase) AS (VALUES {_TEMPS}),
tg AS (SELECT t, phrase, i - 1 AS tpos, array_to_string(tw[i:i + CASE WHEN phrase THEN {PHRASE_GRAM - 1} ELSE {NOTICE_GRAM - 1} END], ' ') AS g
       FROM temps, unnest(generate_series(1, len(tw) - CASE WHEN phrase THEN {PHRASE_GRAM - 1} ELSE {NOTICE_GRAM - 1} END)) u(i)),
g AS (SELECT doc_id, k = {PHRASE_GRAM} AS phrase, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM d, (VALUES ({PHRASE_GRAM}), ({NOTICE_GRAM})) v(k), unnest(generate_series(1, len(w) - k + 1)) u(i) WHERE len(w) >= k),
votes AS (SELECT doc_id, t, phrase, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS a, max(pos) AS b FROM g JOIN tg USING (phrase, g) GROUP BY ALL),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS grp FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= CASE WHEN phrase THEN 0 ELSE {NEAR} END THEN 0 ELSE 1 END AS apart FROM votes)),
cand AS (
  SELECT doc_id, t, any_value(phrase) AS phrase, min(CASE WHEN phrase THEN diagonal ELSE a END) AS a, max(b) + CASE WHEN any_value(phrase) THEN {PHRASE_GRAM} ELSE {NOTICE_GRAM} END AS b, sum(votes) AS votes
  FROM grouped GROUP BY doc_id, t, grp),
seen AS (
  SELECT c.doc_id, label, c.phrase, c.a, c.b, len(tw) AS size,
         CASE WHEN c.phrase THEN CASE WHEN w[c.a + 1:c.a + len(tw)] = tw THEN len(tw) ELSE 0 END ELSE (
           SELECT count(DISTINCT i + k) FROM unnest(generate_series(1, len(tw) - {NOTICE_GRAM - 1})) u(i), generate_series(0, {NOTICE_GRAM - 1}) v(k)
           WHERE list_contains(list_transform(generate_series(c.a + 1, c.b - {NOTICE_GRAM - 1}), lambda j: array_to_string(w[j:j + {NOTICE_GRAM - 1}], ' ')),
                               array_to_string(tw[i:i + {NOTICE_GRAM - 1}], ' '))) END AS covered
  FROM cand c JOIN temps USING (t) JOIN d USING (doc_id)
  WHERE votes >= CASE WHEN c.phrase THEN len(tw) - {PHRASE_GRAM - 1} ELSE ceil(ceil(len(tw) * {SHARE}) / {NOTICE_GRAM}) END AND c.a >= 0),
regions AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, phrase ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS region FROM (
  SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY doc_id, phrase ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM seen WHERE NOT phrase OR covered > 0)),
judged AS (SELECT *, covered::DOUBLE / size AS share,
                  phrase OR (covered >= ceil(size * {SHARE}) AND covered * 10000 - size = max(covered * 10000 - size) OVER (PARTITION BY doc_id, phrase, region)) AS found FROM regions),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE phrase) AS n_base, min(a) FILTER (WHERE phrase) AS first_word, max(a) FILTER (WHERE phrase) AS last_word,
         list_sort(list(DISTINCT label) FILTER (WHERE phrase)) AS base, list_sort(list(DISTINCT label) FILTER (WHERE found)) AS every, max(share) AS score
  FROM judged GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(every, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (doc_id)
"""


@query("op11_license_scan", OP11_SQL)
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
