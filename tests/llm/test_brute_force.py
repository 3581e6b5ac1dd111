"""Operators against direct restatements on small documents."""

import binascii
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from data import WORDS, corpus, frame, words
from missive.llm import near_dups, packing, quality_rules, substring_dedup, toxicity, url_filters
from missive.llm.common import shared_table
from missive.llm.components import components
from missive.llm.language_id import fit_languages, identify, train
from missive.llm.mixing import mixed_documents, mixture
from missive.llm.topk import exact_top_k

DOCS = corpus()


def shingles(text, k):
    w = [x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_groups(pairs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in pairs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    got = near_dups.near_duplicates(frame(spark, DOCS), shingle=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_groups(DOCS, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_one_large_group_in_many_blocks(spark):
    """Near copies around one text, half of them below the limit to each other; several blocks."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(j) for j in range(120)]
    pairs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"x{i}y{rng.random()}"
        pairs.append((i, " ".join(w)))
    got = near_dups.near_duplicates(frame(spark, pairs), shingle=2, block=4000)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == near_groups(pairs, 2)


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(1)
    mul, add = near_dups._permutations(512)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(x[:700]), np.unique(x[200:])
    la, ha = near_dups.min_max(a, mul, add)
    lb, hb = near_dups.min_max(b, mul, add)
    agree = np.concatenate([la == lb, ha == hb]).mean()
    assert abs(agree - 500 / 900) < 0.06


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (300, 300), (None, 5), (150, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_by_windows(pairs, window):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    few = [(500 + i, " ".join(rng.choice("ab") for _ in range(80))) for i in range(6)]     # many ties of anchors
    pairs = DOCS + few + [(700, "p q r s t u v " * 20)]
    got = substring_dedup.substring_digest(frame(spark, pairs), window=window).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == cut_by_windows(pairs, window)


def test_cut_text_keeps_everything_else(spark):
    want = cut_by_windows(DOCS, 20)
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(frame(spark, DOCS)).collect()}
    for i, t in DOCS:
        assert hashlib.sha256(b" ".join(words(got[i]["text"]))).hexdigest() == want[i][2]
        if want[i][1] == 0:
            assert got[i]["text"] == t
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_quality_measures(spark):
    pairs = DOCS + [(800, "# a # b | c <d> & e $ f % g * h"), (801, "again and again and again and again and again and again"),
                    (802, "line one here\nline one here\n\n  \nline two here\n- item\n• item …"), (803, "the of and to in is it was for on THE AND OF")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, pairs)).collect()}
    for i, t in pairs:
        w = [x.decode() for x in words(t)]
        grams = Counter(tuple(w[s:s + 5]) for s in range(len(w) - 4))
        repeat = {s + k for s in range(len(w) - 4) if grams[tuple(w[s:s + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    pairs = DOCS + [(600, " ".join(rng.choice(WORDS) for _ in range(3000))), (601, ""), (602, None), (603, "a<|endoftext|>b Don't İ ﬁ")]
    rows = packing.pack(frame(spark, pairs), size=256, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == binascii.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        ps = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum((p["ids"] for p in ps), []) == ids
        assert [p["start"] for p in ps] == list(range(0, len(ids), 256))
        assert len(ids) > 256 or len(ps) == 1
    total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
        total += at
    assert len(by_seq) <= math.ceil(total / 256) * 1.03 + 1
    whole = packing.sequences(packing.pack(frame(spark, pairs), size=256, with_ids=True))
    assert whole.agg({"length": "sum"}).first()[0] == total


@pytest.mark.parametrize("seed, cuts", [(1, 2), (2, 3), (3, 5)])
def test_packing_plan_against_a_known_optimum(seed, cuts):
    """Full sequences cut in pieces at random: the best packing has as many sequences again."""
    rng = np.random.default_rng(seed)
    lengths = []
    for _ in range(3000):
        at = np.unique(np.concatenate(([0, 300], rng.integers(1, 300, rng.integers(0, cuts + 1)))))
        lengths += np.diff(at).tolist()
    lengths, counts = np.unique(lengths, return_counts=True)
    plan = packing.solve(lengths, counts, 300)
    used = Counter()
    for config, m in plan:
        assert int((config[0] * config[1]).sum()) <= 300
        for length, n in config.T.tolist():
            used[length] += n * m
    assert used == Counter(dict(zip(lengths.tolist(), counts.tolist())))
    assert sum(m for _, m in plan) <= 3000 * 1.02


@pytest.mark.parametrize("prices", [1, 2, 3])
def test_knapsack_against_enumeration(prices):
    rng = np.random.default_rng(prices)
    lengths = np.unique(rng.integers(3, 12, 4))
    worth = rng.random(lengths.size)
    import itertools
    best = max(sum(w * n for w, n in zip(worth, c)) for c in itertools.product(range(9), repeat=lengths.size)
               if sum(int(a) * n for a, n in zip(lengths, c)) <= 24)
    a = packing.knapsack(lengths, worth, 24)
    assert int(a @ lengths) <= 24 and abs(float(a @ worth) - best) < 1e-9


@pytest.mark.parametrize("shape", ["spread", "ties", "one value"])
def test_exact_top_k(spark, shape):
    rng = random.Random(shape)
    span = {"spread": 900, "ties": 2, "one value": 0}[shape]
    rows = [(i, [float(rng.randint(-span, span)) + 1 for _ in range(6)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [5.0, 2.0]), (None, [1.0] * 6)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), __import__("pyspark").sql.functions.expr("vec_id % 20 = 0"),
                      k=7, pivots=8, group=4, block=64).collect()
    good = {i: v + [0.0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in good if i % 20 == 0]:
        want = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:7]
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(-s, i) for _, i, s in mine] == want
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))


def test_top_k_rings_prune_far_cells(spark):
    """Well separated groups: what is replicated is far less than all pairs of groups and data."""
    rng = np.random.default_rng(0)
    centre = np.eye(8) * 1000
    rows = [(i, (centre[i % 8] + rng.integers(-5, 6, 8)).astype(float).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(df, __import__("pyspark").sql.functions.expr("vec_id % 20 = 0"), k=5, pivots=16, group=5).collect()
    assert len(got) == 200 and all((r["id"] - r["query_id"]) % 8 == 0 for r in got)


def mix_weights(tokens, exponent):
    total = sum(tokens.values())
    p = {s: (t / total) ** exponent for s, t in tokens.items() if t}
    z = sum(p.values())
    return {s: x / z for s, x in p.items()}


@pytest.mark.parametrize("target", [{"max_epochs": 1.4}, {"target_entropy": 1.2}, {"max_epochs": 1.5, "cover": True}])
def test_mixture(spark, target):
    rng = random.Random(11)
    pairs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(240)]
    df = frame(spark, pairs).selectExpr("doc_id", "text", "CASE WHEN doc_id % 10 < 6 THEN 'hot' WHEN doc_id % 10 < 8 THEN 'mid' WHEN doc_id % 10 = 8 THEN 'low' END AS source")
    rows = mixture(df, block_tokens=800, **target).collect()
    n = {i: len(words(t)) for i, t in pairs}
    source = {r["doc_id"]: r["source"] or "" for r in df.collect()}
    tokens = Counter()
    for i, s in source.items():
        tokens[s] += n[i]
    used, uses = Counter(), Counter()
    for r in rows:
        assert r["n_tokens"] == n[r["doc_id"]] and r["source"] == source[r["doc_id"]]
        used[r["source"]] += r["n_tokens"]
        uses[r["doc_id"]] += 1
    total = sum(used.values())
    grid = [k / 4000 for k in range(4001)]
    if "target_entropy" in target:
        ok = [a for a in grid if -sum(x * math.log(x) for x in mix_weights(tokens, a).values()) >= 1.2]
        want = mix_weights(tokens, max(ok, default=0.0))
    elif target.get("cover"):
        ok = [a for a in grid if (lambda e: max(e) / min(e) <= 1.5)([x / tokens[s] for s, x in mix_weights(tokens, a).items()])]
        want = mix_weights(tokens, min(ok))
        assert set(uses) == {i for i in n if n[i]}
    else:
        ok = [a for a in grid if max(x * sum(tokens.values()) / tokens[s] for s, x in mix_weights(tokens, a).items()) <= 1.4]
        want = mix_weights(tokens, min(ok, default=1.0))
    for s, x in want.items():
        assert abs(used[s] / total - x) < 0.03
    for s in want:                                       # whole epochs before a document is used again
        times = [uses[i] for i in source if source[i] == s and n[i]]
        assert max(times) - min(times) <= 1
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in blocks.values())


def test_mixed_documents_have_the_columns_of_documents(spark):
    df = frame(spark, DOCS)
    out = mixed_documents(df, max_epochs=1.3, cover=True)
    assert out.columns == df.columns and {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in DOCS}


def test_url_filter_as_of(spark):
    import datetime as dt
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "c.org"]
    entries = [(rng.choice(["host:a.example.com", "domain:example.com", "domain:c.org", "prefix:a.example.com/x", "host:c.org"]), day(rng.randrange(60)), rng.random() < 0.6)
               for _ in range(80)] + [(None, day(1), True), ("host:c.org", None, True), ("host:c.org", day(1), None)]
    caps = [(i, f"https://u@{rng.choice(hosts).upper()}:8080/{rng.choice(['x', 'y', 'x/z'])}?q=1", day(rng.randrange(60))) for i in range(120)]
    caps += [(500, None, day(3)), (501, "/relative", day(3)), (502, "http://c.org", None), caps[0]]
    got = {r["page_id"]: r for r in url_filters.url_filter(spark.createDataFrame(caps, "page_id long, url string, fetched_on date"),
                                                           spark.createDataFrame(entries, "key string, on_date date, listed boolean")).collect()}
    state = {}
    for k, d, v in entries:
        if None not in (k, d, v):
            state.setdefault(k, {}).setdefault(d, False)
            state[k][d] |= v

    def active(k, at):
        past = [d for d in state.get(k, {}) if at is not None and d <= at]
        return bool(past) and state[k][max(past)]
    assert len(got) == 123
    for i, url, at in caps:
        host = url.split("@")[1].split(":")[0].lower() if url and "@" in url else ("c.org" if url == "http://c.org" else "")
        path = [p for p in (url.split("8080")[1].split("?")[0].split("/") if url and "8080" in url else []) if p]
        labels = host.split(".")
        keys = {"host:" + host} | {"domain:" + ".".join(labels[j:]) for j in range(len(labels))} | {f"prefix:{host}/" + "/".join(path[:j + 1]) for j in range(len(path))}
        hits = sorted(k for k in keys if host and active(k, at))
        assert (got[i]["n_active"], got[i]["entry"], got[i]["kept"]) == (len(hits), hits[0] if hits else None, not hits)


def test_language_evidence(spark):
    rng = random.Random(2)
    sound = {"en": ["th", "ing", "on", "er"], "de": ["sch", "ung", "ei", "ch"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(sound[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(("en", "de")[i % 2], 40), ("en", "de")[i % 2], f"h{i % 3}") for i in range(200)]
    model = train([r[1] for r in rows], [r[2] for r in rows])
    test = [(0, text("en", 30), "en", None), (1, text("de", 30), "en-GB", None), (2, "", "de", "x.de"), (3, None, None, None), (4, "###### 1234 %%%% ++++", None, None), (5, "xyz", "de", "only-de")]
    test += [(10 + i, text("de", 20), None, "only-de") for i in range(50)]
    df = spark.createDataFrame(test, "doc_id long, text string, markup string, h string")
    from pyspark.sql import functions as F
    got = {r["doc_id"]: r for r in identify(df, model, declared=F.col("markup"), host=F.col("h")).collect()}
    assert (got[0]["language"], got[0]["kept"]) == ("en", True)
    assert (got[1]["language"], got[1]["kept"]) == ("de", True)          # the text outweighs the declaration
    assert not got[2]["kept"] and not got[3]["kept"] and not got[4]["kept"]
    assert got[5]["language"] == "de"                                     # host and markup decide a text that says nothing
    whole = identify(df, model, declared=F.col("markup"), host=F.col("h"), whole=True)
    assert whole.columns == df.columns and {r["doc_id"] for r in whole.collect()} == {i for i, r in got.items() if r["kept"]}


def test_language_accuracy_on_documents_held_out(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs, usable=F.expr("doc_id % 2 = 0"))
    got = identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.99 and got["kept"].mean() > 0.99


def test_every_declared_language_is_trained(spark):
    """More languages than the 64 that were once trained: none is mapped to 'und'."""
    rng = random.Random(5)
    codes = [a + b for a in "abcdefg" for b in "abcdefghij"]
    vocabulary = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for c in codes}
    rows = [(i, " ".join(rng.choice(vocabulary[c]) for _ in range(40)), c, f"s{i % 3}") for i, c in enumerate(codes * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).persist()
    model = fit_languages(docs)
    assert model[0] == codes and model[1].shape[1] == len(codes) + 1
    from pyspark.sql import functions as F
    got = {r["doc_id"]: r for r in identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(got[i]["language"] == c and got[i]["kept"] for i, _, c, _ in rows)
    with pytest.raises(ValueError, match="more than 69"):
        fit_languages(docs, most_languages=69)


def test_fold_and_matcher():
    assert toxicity.fold("You 1DI0T, іdіоt!") == " you idiot idiot "
    assert toxicity.fold("in 2024 a 7 b") == " in 2024 a 7 b "
    m = toxicity.Matcher({" idiot ": 4.0, " trash ": 2.0, " achlich": 1.5, " achlichen ": 3.0})
    assert m.measure("An IDIOT. trash can, trash; achlichkeit Achlichen") == (4.0 + 2.0 + 1.5 + 3.0, 4, 7)
    assert m.measure("") == (0.0, 0, 0) and m.measure("misachlich") == (0.0, 0, 1)


@pytest.mark.parametrize("key, label, held, least", [("op8_toxicity", "toxic", (4, 2), 0.9), ("op9_quality_classifier", "quality", (5, 0), 0.95)])
def test_held_out_scores(spark, key, label, held, least):
    from missive.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES[key](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(binascii.crc32(str(i).encode()) % held[0] == held[1] for i in got["doc_id"])
    rank = got["score"].rank()
    pos = got[label] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > least and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_line_field_forward_backward_against_enumeration():
    import itertools
    from missive.llm.quality_crf import marginals
    rng = np.random.default_rng(4)
    per = np.array([3, 0, 5, 1])
    score, start, trans = rng.normal(size=9), 0.3, rng.normal(size=(2, 2))
    good, pair, logz = marginals(score, per, start, trans)
    at, want, want_pair, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in per:
        s = score[at:at + n]
        at += n
        if not n:
            continue
        z, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            v = math.exp(start * y[0] + sum(s[t] * y[t] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
            z += v
            marg += v * np.array(y)
            for t in range(1, n):
                pr[y[t - 1], y[t]] += v
        want += (marg / z).tolist()
        want_pair += pr / z
        want_z += math.log(z)
    assert np.allclose(good, want) and np.allclose(pair, want_pair) and math.isclose(logz, want_z)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = frame(spark, DOCS)
    d = str(tmp_path)
    docs.write.parquet(d + "/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dups", "substring_dedup", "mixing", "packing"]
    now = spark.read.parquet(d + "/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        now = shared_table(stage(spark, now, d), name)
        after[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {r["doc_id"] for r in after["language_id"].collect()}
    assert ids == {i for i, _ in DOCS}
    groups = near_groups(DOCS, 5)
    kept = {i for i in ids if groups[i][1] == i}
    assert {r["doc_id"] for r in after["near_dups"].collect()} == kept
    want = cut_by_windows([(i, t) for i, t in DOCS if i in kept], 20)
    cut = {r["doc_id"]: r["text"] for r in after["substring_dedup"].collect()}
    assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in cut.items()} == {i: v[2] for i, v in want.items()}
    mixed = Counter(r["doc_id"] for r in after["mixing"].collect())
    assert set(mixed) == {i for i, t in cut.items() if words(t)}
    packed = Counter(r["doc_id"] for r in after["packing"].where("piece = 0").collect())
    assert packed == mixed
    assert corpus_pipeline.run(spark, d).count() == after["packing"].count()


@pytest.mark.parametrize("seed,times", [(1, 1), (2, 40)])
def test_packing_comes_from_the_program_and_never_exceeds_the_filler(seed, times):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.clip(rng.lognormal(4, 0.9, 900), 1, 512).astype(np.int64), return_counts=True)
    counts = counts * times
    plan, n, n_program = packing._solve(lengths, counts, 512)
    used = {}
    for config, copies in plan:
        assert int((config[0] * config[1]).sum()) <= 512
        for length, k in config.T.tolist():
            used[length] = used.get(length, 0) + k * copies
    assert used == dict(zip(lengths.tolist(), counts.tolist())) and n == sum(m for _, m in plan)
    filler = sum(m for _, m in packing.rounded(lengths, counts, 512, {}, 0)[0])
    assert n <= filler and 2 * n_program > n


def test_no_source_vanishes_from_a_mixture(spark):
    """Fifty-one sources of one token beside one of a million; a thousand equal ones on a short budget."""
    from missive.llm.mixing import mixture
    docs = spark.range(51).selectExpr("id AS doc_id", "concat('s', id) AS source", "1L AS n").unionByName(
        spark.createDataFrame([(1000, "big", 1_000_000)], "doc_id long, source string, n long")).withColumn("text", F.lit("x"))
    got = mixture(docs, tokens=F.col("n"), max_epochs=1.25)
    assert got.select("source").distinct().count() == 52
    even = spark.range(1000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'x' AS text")
    assert mixture(even, budget=300, max_epochs=1.25).count() == 300
