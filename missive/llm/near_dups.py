"""Near-duplicates by min-max hashing with exact confirmation.

Each document's set of word shingles gives, under every permutation, both its smallest
and its largest value: P permutations make 2P signature values, all of them unbiased for
the Jaccard similarity.  Bands of R values (minima and maxima in bands of their own)
become bucket keys.  Equal sets are one node from the start (copies are never paired).

Links are confirmed on full sets without listing pairs: each bucket names its smallest
member as hub, and since all members of a bucket share its hub, the documents of one hub
cover every candidate pair.  A hub's documents are dealt in blocks of bounded size to
tasks (one per pair of blocks); a task tests what is not yet connected and returns only
the links that join parts.  Components follow by star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import ID_FILTER, arrow_rows, drop_tables, one_row_per_id, shared_table, texts_of
from missive.llm.components import components
from missive.llm.words import find_words, lists, mix, runs, signed, slices, word_hashes
from missive.session import ship_package

PERMUTATIONS, ROWS = 168, 7          # 2 * 168 values in 48 bands of 7: a pair at 0.8 is missed with p = 1.2e-5
BLOCK = 400_000                      # shingles that one block of a hub's documents holds


def _permutations(n: int):
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint32))


def min_max(x: np.ndarray, mul: np.ndarray, add: np.ndarray):
    """Smallest and largest value of the set under each permutation; one evaluation each."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    lo = np.full(mul.size, 0xFFFFFFFF, np.uint32)
    hi = np.zeros(mul.size, np.uint32)
    for i in range(0, x.size, 2048):
        v = x[None, i:i + 2048] * mul[:, None] + add[:, None]
        np.minimum(lo, v.min(axis=1), out=lo)
        np.maximum(hi, v.max(axis=1), out=hi)
    return lo, hi


def band_keys(lo: np.ndarray, hi: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    sig = np.concatenate([lo.reshape(-1, rows), hi.reshape(-1, rows)]).astype(np.uint64)
    key = np.arange(1, len(sig) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix(key ^ sig[:, k])
    return key


def shingle_sets(col: pa.Array, k: int):
    """The sorted distinct k-word shingles of each text; a shorter text is one shingle."""
    for i, j, buf, off in slices(col):
        starts, ends, first = find_words(buf, off)
        h = word_hashes(buf, starts, ends, lower=True)
        full = runs(h, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(full[a:b - k + 1])
            elif b > a:
                yield runs(h[a:b], int(b - a), salt=int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _signatures(k: int, permutations: int, rows: int):
    def run(batches):
        mul, add = _permutations(permutations)
        n_bands = 2 * permutations // rows
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for x in shingle_sets(batch.column(1), k):
                n.append(x.size)
                d1.append(np.sum(mix(x), dtype=np.uint64))
                d2.append(np.sum(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
                if x.size:
                    keys.append(band_keys(*min_max(x, mul, add), rows))
            n = np.array(n, np.int64)
            all_keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), pa.array(signed(np.array(d1, np.uint64))), pa.array(signed(np.array(d2, np.uint64))),
                lists(signed(all_keys), (n > 0) * n_bands, pa.int64())], names=["id", "n", "d1", "d2", "keys"])
    return run


def linked_pairs(ids, sets, blocks, home: tuple[int, int], percent: int):
    """Links (as index pairs) that connect what is linked among the given sets.

    The first set is the hub.  ``home`` (i, j): with i = j pairs inside the block are
    tested, otherwise only pairs across the two blocks.  Sets in one part already are not
    tested again; the others meet through an index of their shingles.
    """
    m = len(ids)
    part = np.arange(m)                        # part of each set; a join renames the smaller one
    held = np.ones(m, np.int64)

    def join(a, b):
        a, b = part[a], part[b]
        if held[a] < held[b]:
            a, b = b, a
        part[part == b] = a
        held[a] += held[b]

    size = np.array([s.size for s in sets], np.int64)
    tok = np.concatenate(sets)
    doc = np.repeat(np.arange(m), size)
    order = np.argsort(tok, kind="stable")
    tok, doc = tok[order], doc[order]
    out = []

    def common(a):
        lo, hi = np.searchsorted(tok, sets[a], "left"), np.searchsorted(tok, sets[a], "right")
        cnt = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt) + np.arange(cnt.sum())
        return np.bincount(doc[at], minlength=m)

    def linked(a):
        inter = common(a)
        return (inter > 0) & (100 * inter >= percent * (size[a] + size - inter))

    for b in np.flatnonzero(linked(0)):
        if part[b] != part[0]:
            join(0, b)
            if home[0] == home[1]:
                out.append((0, b))
    for a in range(1, m):
        # the part of the hub is large: its own members leave the tests to the others
        if part[a] == part[0]:
            continue
        rest = part != part[a]
        if home[0] != home[1]:
            rest &= blocks != blocks[a]
        rest &= (100 * size >= percent * size[a]) & (100 * size[a] >= percent * size)
        rest[0] = False
        if not rest.any():
            continue
        for b in np.flatnonzero(linked(a) & rest):
            if part[a] != part[b]:
                join(a, b)
                out.append((a, b))
    return out


def _confirm(k: int, percent: int):
    """Rows (hub, i, j, id, block, text) sorted by task to links (a, b)."""
    def solve(task, rows):
        hub, i, j = task
        rows = {r[0]: r for r in rows}                       # repeated rows are one
        rows = sorted(rows.values(), key=lambda r: (r[0] != hub, r[0]))
        ids = [r[0] for r in rows]
        if len(ids) < 2:
            return []
        sets = [s for s in shingle_sets(pa.array([r[2] for r in rows], pa.large_string()), k)]
        pairs = linked_pairs(ids, sets, np.array([r[1] for r in rows]), (i, j), percent)
        return [(ids[a], ids[b]) for a, b in pairs]

    def run(batches):
        task, rows, links = None, [], []
        for batch in batches:
            for hub, i, j, one, block, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, i, j) != task:
                    if task is not None:
                        links += solve(task, rows)
                    task, rows = (hub, i, j), []
                rows.append((one, block, text))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
                links = []
        if task is not None:
            links += solve(task, rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` and ``kept`` (it is the smallest
    id of its component).

    Words are runs of non-blank bytes with A-Z folded; a text with fewer words than a
    shingle is one shingle; an empty or null text has no shingle and no link.  Each row gives
    a row, so an id must not stand for different texts: callers merge them first
    (``one_row_per_id``, as ``op7`` and ``without_near_duplicates`` do).  A null id links its text's set but is never a component's id:
    such a row is kept only if no row with an id holds its set.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = shared_table(texts.mapInArrow(_signatures(shingle, permutations, rows), "id long, n long, d1 long, d2 long, keys array<long>"), "nd-sig")
    nodes = shared_table(sig.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "nd-nodes")
    live = nodes.where("id IS NOT NULL")

    keys = live.select("id", "n", F.explode("keys").alias("key"))
    buckets = (keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("hub")).where("c > 1")
               .select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    buckets = shared_table(buckets, "nd-buckets")
    members = keys.join(buckets, "key").where("id <> hub").select("hub", "hub_n", "id", "n").distinct()
    members = shared_table(members, "nd-members")
    sizes = members.groupBy("hub", "hub_n").agg(F.sum("n").alias("total"))
    sizes = shared_table(sizes.withColumn("blocks", F.ceil(F.col("total") / F.lit(block)).cast("int")), "nd-sizes")
    # each document of a hub goes to the block pairs of its block, the hub to all of them
    dealt = (members.join(sizes.select("hub", "blocks"), "hub")
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("hub", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "id", "block"))
    hubs = (sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
            .select("hub", "i", "j", F.col("hub").alias("id"), F.lit(-1).alias("block")))
    dealt = shared_table(dealt.unionByName(hubs), "nd-dealt")
    tasks = (texts_of(texts.withColumnRenamed("text", "body"), dealt)
             .select("hub", "i", "j", "id", "block", "body")
             .repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j"))
    links = shared_table(tasks.mapInArrow(_confirm(shingle, percent), "a long, b long"), "nd-links", **ID_FILTER)
    roots = components(links)
    named = shared_table(nodes.select("d1", "d2", "n", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
                         .select("d1", "d2", "n", F.coalesce("root", "id").alias("component")), "nd-named")
    out = sig.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                     F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
    drop_tables(nodes, buckets, members, sizes, dealt)
    return out


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each group kept; columns as given.  Rows without an id go
    (nothing could name them later); rows of one id are one document."""
    docs = one_row_per_id(docs.where(F.col(id_col).isNotNull()), id_col)
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(id_col)
    # the ids grow with the corpus: never broadcast, one plan at every size
    return docs.join(shared_table(kept, "nd-kept").hint("shuffle_hash"), id_col, "left_semi")
