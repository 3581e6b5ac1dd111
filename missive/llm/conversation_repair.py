"""Repair of conversation structure: the cheapest edits to a well-formed exchange.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles.  Edits: Keep a row
(0), Rerole it to user or assistant (2), Delete it (3; the only edit of blank and duplicate
rows), Insert an empty user or assistant row anywhere (2); a truncated row that stays adds 1.
Of the cheapest edit sequences the one with the ASCII-least audit (its edits' initials) wins.

Weighted interval parsing: the repair grammar in Chomsky normal form has one nonterminal
[p, q] for every two states of the pattern, the rules [p, q] -> [p, r] [r, q] and [p, q] ->
edit of one row; a span's cell holds the least (cost, audit) of every nonterminal and is
closed under insertions.  Cells are combined bottom-up by span length.  As some [p, r] [r, q]
derives a span whichever place it is split at, one split per span is enough: lengths double
(1, 2, 4, ...), so a span of n rows takes n - 1 combinations.  An audit is never a proper
prefix of another one of equal cost (the rest would be insertions, which cost), so the least
audits of two spans concatenate to the least audit of both.

In Spark, only a letter per row is parsed.  Rows are numbered per conversation by range
partitioning and cut in blocks of ``BLOCK``; blocks are parsed in parallel, their cells
combined ``FAN`` at a time until one is left, and the chosen nonterminals handed back down to
the blocks.  A last pass streams every conversation's rows behind its blocks' audits.

Rules: null roles and texts read as one space; rows go by turn, nulls first (then by role
and hash of role and text; equal rows stand together); null conversation ids are one
conversation; a conversation without rows is not in the result.  A role other than s..., u...
or a... can only be reroled or deleted.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import group_key, shared_table
from missive.operators.ordering import global_row_number
from missive.session import ship_package

BLOCK = 256
FAN = 64
BLANKS = " \t\n\x0b\f\r"
ROW_BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}

# The pattern (s?(ua)+)? as states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


# --- cells -----------------------------------------------------------------------------

def _least(cell: dict, key: tuple, value: tuple) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: dict, right: dict) -> dict:
    """[p, q] -> [p, r] [r, q]: the cell of two adjacent spans.  Values are (cost, audit)."""
    out: dict = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                _least(out, (p, q), (c1 + c2, a1 + a2))
    return out


def _closure() -> dict:
    """Cheapest insertions between any two states."""
    one = {(p, p): (0, "") for p in range(4)}
    for (p, role), q in MOVES.items():
        if role != "s":
            _least(one, (p, q), (INSERT, "I"))
    while True:
        more = dict(one)
        for key, value in combine(one, one).items():
            _least(more, key, value)
        if more == one:
            return one
        one = more


CLOSURE = _closure()


def _unit(letter: str) -> dict:
    """Cell of one row: its edits, closed under insertions on both sides."""
    role, fault = "suax"[(ord(letter) - 97) // 4], (ord(letter) - 97) % 4
    cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in (0, 3):
        extra = TRUNCATED if fault == 3 else 0
        for (p, to), q in MOVES.items():
            if to == role:
                _least(cell, (p, q), (KEEP + extra, "K"))
            if to != "s":
                _least(cell, (p, q), (REROLE + extra, "R"))
    return combine(combine(CLOSURE, cell), CLOSURE)


UNITS = {chr(97 + k): _unit(chr(97 + k)) for k in range(16)}


def parse(letters: str) -> dict:
    """Cell of a span of rows, combined bottom-up by span length."""
    cells = [UNITS[x] for x in letters] or [CLOSURE]
    while len(cells) > 1:
        pairs = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(pairs) * 2:]
    return cells[0]


def best(cell: dict) -> tuple[int, tuple[int, str]]:
    """Accepting state and (cost, audit) of the cheapest repair."""
    return min(((q, cell[0, q]) for q in ACCEPT if (0, q) in cell), key=lambda x: x[1])


def combine_many(cells: list[dict]) -> dict:
    """Cell of adjacent spans; values are (cost, audit, states between the spans)."""
    out = {k: (c, a, "") for k, (c, a) in cells[0].items()}
    for cell in cells[1:]:
        nxt: dict = {}
        for (p, r), (c1, a1, via) in out.items():
            for (r2, q), (c2, a2) in cell.items():
                if r == r2:
                    _least(nxt, (p, q), (c1 + c2, a1 + a2, via + str(r)))
        out = nxt
    return out


def _illegal(pairs) -> int:
    return sum(x not in ("su", "ua", "au") for x in pairs)


# --- rows to letters -------------------------------------------------------------------

def rows_of(conversations: DataFrame) -> DataFrame:
    """cid, conv_id, turn, role, text and a 128-bit key of role and text."""
    x = conversations.select(group_key(F.col("conv_id")).alias("cid"), "conv_id", "turn",
                             F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return x.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(1), "text", "role")})


def _lettered(rows: DataFrame) -> DataFrame:
    """One row per distinct (cid, turn, role, text) with the letters of all its copies.

    A letter is a role (s, u, a, other) and a fault (none, blank, duplicate, truncated).
    Copies and earlier equal rows are found by aggregates, so a row that is most of a
    conversation is combined before the shuffle."""
    tail = F.rtrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(tail == "", 1).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    x = rows.select("cid", "conv_id", "turn", "k1", "k2", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), fault.alias("fault"))
    key = ["cid", "k1", "k2"]
    distinct = x.groupBy(*key, "turn").agg(F.count(F.lit(1)).alias("copies"), F.first("conv_id").alias("conv_id"), F.first("initial").alias("initial"),
                                           F.first("kind").alias("kind"), F.first("fault").alias("fault"))
    again = (x.groupBy(*key).agg(F.min(F.struct("turn")).alias("from"), F.max(F.struct("turn")).alias("to"))
             .where("from < to").select(*key, "from"))
    flagged = distinct.join(again, key, "left")
    seen = F.coalesce(F.struct("turn") > F.col("from"), F.lit(False))

    def letter(f: Column) -> Column:
        return F.char(97 + F.col("kind") * 4 + f)

    later = letter(F.when(F.col("fault") == 1, 1).otherwise(2))
    here = letter(F.when((F.col("fault") != 1) & seen, 2).otherwise(F.col("fault")))
    return flagged.select("cid", "conv_id", "turn", "initial", "k1", "k2",
                          F.concat(here, F.repeat(later, F.col("copies").cast("int") - 1)).alias("letters"))


# --- parsing in blocks -----------------------------------------------------------------

CELLS = "array<struct<p:int,q:int,cost:long,audit:string,via:string>>"
SPAN = f"cid string, block long, cells {CELLS}, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _emit(batch: list) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in "cid,block,cells,blank,duplicate,truncated,illegal,first,last".split(",")]
    cell = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.string())]))
    kinds = [pa.string(), pa.int64(), cell, *[pa.int64()] * 4, pa.string(), pa.string()]
    cols = list(zip(*batch)) if batch else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _cells(cell: dict) -> list[dict]:
    return [{"p": p, "q": q, "cost": v[0], "audit": v[1], "via": v[2] if len(v) > 2 else ""} for (p, q), v in cell.items()]


def _parse_blocks(it):
    known: dict = {}                                     # conversations of one shape are parsed once per task
    for batch in it:
        out = []
        for cid, block, letters in zip(*[batch.column(c).to_pylist() for c in ("cid", "block", "letters")]):
            got = known.get(letters)
            if got is None:
                roles = ["suax"[(ord(x) - 97) // 4] for x in letters]
                n = [0, 0, 0, 0]
                for x in letters:
                    n[(ord(x) - 97) % 4] += 1
                got = (_cells(parse(letters)), n[1], n[2], n[3], _illegal(a + b for a, b in zip(roles, roles[1:])), roles[0], roles[-1])
                if len(known) > 20_000:
                    known.clear()
                known[letters] = got
            out.append((cid, block, *got))
        yield _emit(out)


def _combine_blocks(it):
    for batch in it:
        out = []
        for cid, block, spans in zip(*[batch.column(c).to_pylist() for c in ("cid", "block", "spans")]):
            cell = combine_many([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]} for s in spans])
            between = _illegal(a["last"] + b["first"] for a, b in zip(spans, spans[1:]))
            out.append((cid, block, _cells(cell), *[sum(s[k] for s in spans) for k in ("blank", "duplicate", "truncated")],
                        sum(s["illegal"] for s in spans) + between, spans[0]["first"], spans[-1]["last"]))
        yield _emit(out)


def _chosen(frame: DataFrame, p: Column, q: Column) -> Column:
    return F.filter("cells", lambda c: (c["p"] == p) & (c["q"] == q))[0]


def repair_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, blocks) of the rows of ``rows_of``.

    report: cid, conv_id, blank, duplicate, truncated, illegal, cost, audit.
    blocks: cid, the block's first row (turn, initial, k1, k2), its state before (p) and audit.
    """
    ship_package(rows.sparkSession)
    lettered = shared_table(_lettered(rows), "letters")
    order = ["turn", "initial", "k1", "k2"]
    numbered = global_row_number(lettered, order, ["cid"], out="place")
    blocks = numbered.groupBy("cid", F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "letters"))).alias("rows"),
        F.min(F.struct(*order)).alias("head"), F.first("conv_id").alias("conv_id"))
    blocks = shared_table(blocks.select("cid", "block", "head", "conv_id", F.array_join("rows.letters", "").alias("letters")), "letter-blocks")
    levels = [shared_table(blocks.select("cid", "block", "letters").mapInArrow(_parse_blocks, SPAN), "cells")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        spans = (levels[-1].groupBy("cid", F.floor(F.col("block") / FAN).cast("long").alias("above"))
                 .agg(F.sort_array(F.collect_list(F.struct("block", "blank", "duplicate", "truncated", "illegal", "first", "last", "cells"))).alias("spans"))
                 .withColumnRenamed("above", "block"))
        levels.append(shared_table(spans.mapInArrow(_combine_blocks, SPAN), "cells"))
    ends = F.array_sort(F.transform(F.filter("cells", lambda c: (c["p"] == 0) & c["q"].isin(*ACCEPT)),
                                    lambda c: F.struct(c["cost"], c["audit"], c["q"])))[0]
    top = levels[-1].withColumn("end", ends)
    report = top.select("cid", "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))
    way = top.select("cid", "block", F.lit(0).alias("p"), F.col("end.q").alias("q"))
    for level in reversed(levels[1:]):                   # hand the chosen nonterminals down
        via = F.concat(F.col("p").cast("string"), _chosen(level, F.col("p"), F.col("q"))["via"], F.col("q").cast("string"))
        met = level.join(way, ["cid", "block"]).select("cid", "block", via.alias("via"))
        way = met.select("cid", F.col("block").alias("b"), F.posexplode(F.sequence(F.lit(1), F.length("via") - 1)).alias("i", "k"), "via").select(
            "cid", (F.col("b") * FAN + F.col("i")).alias("block"), F.substring("via", F.col("k"), F.lit(1)).cast("int").alias("p"),
            F.substring("via", F.col("k") + 1, F.lit(1)).cast("int").alias("q"))
    pieces = levels[0].join(way, ["cid", "block"]).select("cid", "block", "p", _chosen(levels[0], F.col("p"), F.col("q"))["audit"].alias("audit"))
    heads = blocks.drop("letters").join(pieces, ["cid", "block"])
    return report, heads.select("cid", "conv_id", *[F.col(f"head.{c}").alias(c) for c in order], "p", "audit")


# --- repaired rows ---------------------------------------------------------------------

STREAM = [("cid", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


def _edit_rows(it):
    """Rows in order, each block's audit (a row with ``p``) before its rows."""
    cid = piece = None
    at = state = place = 0
    for batch in it:
        out: list = []

        def put(role, text, edit):
            nonlocal place
            out.append((cid, place, role, text, edit))
            place += 1

        def insert():
            nonlocal at, state
            while at < len(piece) and piece[at] == "I":
                role = "assistant" if state == 2 else "user"
                state, at = MOVES[state, role[0]], at + 1
                put(role, "", "insert")

        for c, p, audit, role, text in zip(*[batch.column(n).to_pylist() for n in ("cid", "p", "audit", "role", "text")]):
            if p is not None:
                if c != cid:
                    cid, place = c, 0
                piece, at, state = audit, 0, p
                insert()
                continue
            edit, at = piece[at], at + 1
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            if edit != "D":
                state = MOVES[state, role[0]]
                put(role, text, "rerole" if edit == "R" else "keep")
            insert()
        cols = list(zip(*out)) if out else [[] for _ in STREAM]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(cols, STREAM)], names=[n for n, _ in STREAM])


def repaired_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """cid, place (from 0), role, text, edit (keep, rerole, insert); inside every partition the
    rows of a conversation stand together and in order."""
    stream = heads.select("cid", "turn", "initial", "k1", "k2", "p", "audit").withColumns(
        {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).unionByName(
        rows.select("cid", "turn", F.substring("role", 1, 1).alias("initial"), "k1", "k2", F.lit(None).cast("int").alias("p"),
                    F.lit(None).cast("string").alias("audit"), "role", "text"))
    stream = stream.repartition("cid").sortWithinPartitions("cid", "turn", "initial", "k1", "k2", F.col("p").isNull())
    return stream.mapInArrow(_edit_rows, "cid string, place long, role string, text string, edit string")


def _hash_rows(it):
    cid = h = None
    n = 0
    schema = pa.schema([("cid", pa.string()), ("n_rows", pa.int64()), ("sha256", pa.string())])

    def done():
        return pa.RecordBatch.from_pylist([{"cid": cid, "n_rows": n, "sha256": h.hexdigest()}], schema=schema)

    for batch in it:
        out = []
        for c, role, text in zip(*[batch.column(k).to_pylist() for k in ("cid", "role", "text")]):
            if c != cid:
                if h is not None:
                    out.append(done())
                cid, h, n = c, hashlib.sha256(), 0
            h.update((("\n" if n else "") + f"{role}:{text}").encode())
            n += 1
        yield from out
    if h is not None:
        yield done()


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """cid, n_rows, sha256 of the newline-joined ``role:text`` lines; reads the rows of
    ``repaired_rows`` as they come, one batch at a time."""
    return repaired.mapInArrow(_hash_rows, "cid string, n_rows long, sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of a table of conversations."""
    rows = rows_of(conversations)
    report, heads = repair_plan(rows)
    return report, repaired_rows(rows, heads)


# --- the damaged table of the query ----------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 dropped, 1 emptied, 2 without ``.!?``,
    3 doubled, 4 made the user's.  Nulls read as one space (turn and id stay null)."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    return x.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_audit(conversations: DataFrame) -> DataFrame:
    """Every conversation of ``conversations`` damaged and repaired: gaps, faults, cost,
    audit and hash of the repaired rows; one without rows left has zeros, an empty audit and
    the hash of nothing."""
    hurt = damaged(conversations)
    report, repaired = repair(hurt)
    hashes = shared_table(conversation_hashes(repaired), "repaired", **ROW_BATCH)
    gaps = hurt.groupBy(group_key(F.col("conv_id")).alias("cid")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = conversations.groupBy(group_key(F.col("conv_id")).alias("cid")).agg(F.first("conv_id").alias("conv_id"))
    out = every.join(gaps, "cid", "left").join(report, "cid", "left").join(hashes, "cid", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
