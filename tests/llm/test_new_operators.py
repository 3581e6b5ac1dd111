"""License scans, Merkle manifest and conversation repair against direct restatements."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from data import ODD, SCHEMA, corpus, frame
from missive.llm import conversation_repair as R
from missive.llm import license_scan as LS
from missive.llm import merkle as M

CONV = "conv_id long, turn long, role string, text string"


# --- 11 --------------------------------------------------------------------------------

def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split(LS.SEPARATORS.replace("\\x", "\\x"), low) if w]
    at = [(i, label) for label, p in LS.PHRASES for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def license_docs():
    notice = dict((a, b) for a, b in LS.NOTICES if len(b.split()) > 20)
    mit = notice["mit"].split()
    texts = [p[1] for p in corpus(12)] + [
        "Released under the MIT License. And the mit license, MIT  LICENSE!", "gnu general public license version 3 / GNU General Public License",
        "cc by cc by nc cc-by 4.0", "Licensed under CC BY-NC 4.0.", "apache licensed", "the apacheé license", " ".join(mit),
        "intro words " + " ".join(mit[:9] + ["really"] + mit[9:20] + mit[21:]) + " outro", " ".join(mit[: len(mit) // 2]),
        "x " * 5000 + notice["bsd"] + " y" * 4500, notice["lgpl"], notice["gpl"], ("mit license " * 4100) + "end", None, "", "  \t", "one"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (3, texts[3]), (3, texts[3])]


def test_license_scan(spark):
    docs = license_docs()
    got = LS.license_scan(frame(spark, docs, extra=True)).collect()
    assert len(got) == len(docs)
    want = sorted(((i, *plain_scan(t)) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == want
    by = {r["doc_id"]: r for r in got}
    assert by[12]["labels"] == "mit" and by[15]["labels"] == "cc-by,cc-by-nc" and by[15]["score"] == 1.0
    assert by[16]["labels"] == "" and by[17]["labels"] == "" and by[18]["labels"] == "mit" and by[18]["n_base"] == 0
    assert by[19]["labels"] == "mit" and 0.8 <= by[19]["score"] < 1.0             # a word more, a word less
    assert by[20]["labels"] == "" and 0 < by[20]["score"] < 0.8                    # half a notice
    assert by[21]["labels"] == "bsd" and by[22]["labels"] == "lgpl" and by[23]["labels"] == "gpl"
    assert by[24]["n_base"] == 4100 and by[24]["last_word"] == 8198


def test_license_scan_templates_and_empty(spark):
    assert LS.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        LS.templates(spark, phrases=[("x", "one")])
    docs = spark.createDataFrame([(1, 1, "under the house rules of the park today")], "id long, id2 long, text string")
    spans = LS.license_spans(docs, LS.templates(spark, [("rules", "house rules")], [])).collect()
    assert [(r["label"], r["start"], r["end"], r["found"]) for r in spans] == [("rules", 2, 4, True)]


# --- 12 --------------------------------------------------------------------------------

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 8 * 8
            out.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = climb([leaf(r) for r in groups[k]])
    top = climb([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            p = path(trees[k], i) + path(top, n)
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                h = leaf((*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in p:
                h = H(a + h + b)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[k][-1][0], root, H("".join(a + b for a, b in p)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 600])
def test_merkle_manifest(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["s", None]), "big" if n > 100 and i % 7 else rnd.choice(["en", "de", "é", None]), rnd.choice([None, i]),
             rnd.choice([None, "", "Some TEXT É \U0001f600", "plain", "Z" * 2000])) for i in range(n)]
    rows += rows[2:4] + ([(None, None, None, None, None)] * 2 + [(5, "s", None, 1, "Other")] if n else [])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("key", "idx", "h", "path", "root", "n", "block", "id"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted((tuple(r) for r in M.tamper_audit(df).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == plain_manifest(rows)
    assert n < 100 or {r[-1] for r in got} == {True, False}


def test_merkle_stores_every_third_level(spark):
    leaves = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("idx"), M.digest(F.col("id").cast("string")).alias("h"))
    tree = M.build_tree(leaves)
    assert [b.selectExpr("sum(size(nodes))").first()[0] for b in tree.stored] == [5000, 10]
    assert tree.stored[0].selectExpr("max(size(nodes))").first()[0] == 512


# --- 13 --------------------------------------------------------------------------------

def plain_repair(rows):
    """(cost, audit, lines): dynamic program over rows and states, whole audits as ties."""
    seen, marks = set(), []
    for role, text in rows:
        body = text.strip(R.BLANKS)
        marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {0: (0, "", ())}

    def better(new, q, v):
        if q not in new or v[:2] < new[q][:2]:
            new[q] = v

    def insert(states):
        for _ in range(3):
            for p, (c, a, ls) in list(states.items()):
                for role in "ua":
                    if (p, role) in R.MOVES:
                        better(states, R.MOVES[p, role], (c + 2, a + "I", (*ls, {"u": "user:", "a": "assistant:"}[role])))
        return states

    states = insert(states)
    for (role, text), mark in zip(rows, marks):
        new = {}
        for p, (c, a, ls) in states.items():
            better(new, p, (c + 3, a + "D", ls))
            if mark in ("", "truncated"):
                extra = int(mark == "truncated")
                if (p, role[:1]) in R.MOVES:
                    better(new, R.MOVES[p, role[:1]], (c + extra, a + "K", (*ls, f"{role}:{text}")))
                for r in "ua":
                    if (p, r) in R.MOVES:
                        better(new, R.MOVES[p, r], (c + 2 + extra, a + "R", (*ls, {"u": "user", "a": "assistant"}[r] + ":" + text)))
        states = insert(new)
    cost, audit, lines = min((states[q] for q in R.ACCEPT if q in states), key=lambda v: v[:2])
    return marks, cost, audit, lines


def plain_audit(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            f = zlib.crc32(name.encode()) % 20
            if f:
                text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
                own += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        marks, cost, audit, lines = plain_repair([r[1:] for r in own])
        first = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"),
                     marks.count("truncated"), illegal, cost, audit, H("\n".join(lines)))
    return out


def test_parse_equals_the_plain_program():
    rnd = random.Random(5)
    for _ in range(400):
        letters = "".join(rnd.choice("abdefhijlmnp") for _ in range(rnd.randint(0, 9)))
        roles = [("system", "user", "assistant", "other")[(ord(x) - 97) // 4] for x in letters]
        rows = [(r, "" if (ord(x) - 97) % 4 == 1 else f"t{i}" + ("" if (ord(x) - 97) % 4 == 3 else "."))
                for i, (r, x) in enumerate(zip(roles, letters))]
        assert R.best(R.parse(letters))[1] == plain_repair(rows)[1:3]
    legal = re.compile("(s?(ua)+)?")
    for n in range(5):                                     # every accepted string is legal and the other way round
        for word in itertools.product("sua", repeat=n):
            p = 0
            for x in word:
                p = R.MOVES.get((p, x)) if p is not None else None
            assert (p in R.ACCEPT) == bool(legal.fullmatch("".join(word)))


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            rows.append((conv, turn, role, rnd.choice([f"Words {turn}.", "Again!", "no end", " \t", "", None, "Why? ", "éè"])))
    return rows + [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (n, None, None, None), (n + 1, 3, "user", "x.")] + [(n + 2, 1, "user", "Same.")] * 5


def test_repair_audit(spark):
    rows = conversations(11, 120)
    df = spark.createDataFrame(rows, CONV).withColumn("cid", F.lit("x")).withColumn("place", F.lit("x")).withColumn("audit", F.lit("x"))
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
           for r in R.repair_audit(df).collect()}
    assert got == plain_audit(rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    """Blocks of a few rows, combined over several levels, give the result of one parse."""
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "user", "system"]), f"Turn {t}" + rnd.choice([".", ".", ""])) for t in range(300)]
    df = spark.createDataFrame(rows, CONV)
    whole = R.repair_audit(df).collect()
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "FAN", 3)
    assert R.repair_audit(df).collect() == whole
    assert {r["conv_id"]: r["repaired_sha256"] for r in whole} == {k: v[-1] for k, v in plain_audit(rows).items()}


def test_repaired_rows_are_well_formed(spark):
    rows = conversations(4, 40)
    _report, repaired = R.repair(spark.createDataFrame(rows, CONV))
    by = {}
    for r in repaired.collect():
        by.setdefault(r["cid"], []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r["place"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in rs))
        assert all(r["text"].strip(R.BLANKS) for r in rs if r["edit"] != "insert")


def test_empty_conversations(spark):
    assert R.repair_audit(spark.createDataFrame([], CONV)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, CONV)
    got = R.repair_audit(nulls).collect()
    assert len(got) == 1 and got[0]["gaps"] == 0 and got[0]["audit"] in ("", "DDD", "DDDDDD", "D" * got[0]["blank"])


def test_odd_documents(spark):
    docs = frame(spark, ODD, extra=True)
    assert LS.license_scan(docs).count() == len(ODD) == M.tamper_audit(docs).count()
