"""Merkle manifest of a table: every row a leaf, one root, a proof per row.

Rows of one group (language) are the leaves of the group's tree, in id order; every
``FANOUT`` consecutive nodes become their digest until one node, the group's subroot, is
left; the subroots in group order are the leaves of one more tree, whose node is the root.

Checkpoint and recompute: only every ``EVERY``-th level is stored, as blocks of
``FANOUT ** EVERY`` consecutive nodes of one group.  Building folds each stored block to its
ancestor on the next stored level.  Proof extraction goes from the root down: each block's
missing interior levels are computed again from its stored nodes, every node takes the
siblings along its way to the block's ancestor plus the ancestor's own way to the root, and
the interior nodes are dropped.  A task holds one block (512 digests), never a group or a
level, so a group with most of the rows is many blocks.

Rules: null fields are ``-``; null groups are one group and come first; null ids come first
in their group; rows of one id are leaves of their own, ordered by digest; a group of one
row is its own subroot; an empty table has no root and no rows.  Only the named columns are
read, so further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import group_key, let, shared_table
from missive.operators.ordering import global_row_number

FANOUT = 8
EVERY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields, each as UTF-8 byte count, ``:`` and value (null: ``-``)."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (f.cast("string") for f in fields)]
    return digest(F.concat(*parts))


@dataclass
class Tree:
    stored: list[DataFrame]     # per stored level: key, block, n (nodes of the key there), nodes (array, field h)
    roots: DataFrame            # key, h


def _join(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _up(nodes: Column) -> Column:
    """The next level: digests of runs of FANOUT nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")),
                       lambda i: digest(_join(F.slice(nodes, i * FANOUT + 1, FANOUT))))


def _levels(hashes: Column, n: Column, body) -> Column:
    """``body([level 0, ..., level EVERY])`` of one block; levels above the root repeat it."""
    def climb(k, levels):
        if k == EVERY:
            return body(levels)
        return let(F.when(n > FANOUT ** k, _up(levels[-1])).otherwise(levels[-1]), lambda up: climb(k + 1, levels + [up]))
    return let(hashes, lambda h: climb(0, [h]))


def build_tree(leaves: DataFrame) -> Tree:
    """``leaves``: key, idx (from 0 per key), h and any payload columns."""
    size = FANOUT ** EVERY
    stored, nodes, counts = [], leaves, leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    while True:
        payload = [c for c in nodes.columns if c not in ("key", "idx", "n")]
        blocks = (nodes.groupBy("key", F.floor(F.col("idx") / size).cast("long").alias("block"))
                  .agg(F.sort_array(F.collect_list(F.struct("idx", *payload))).alias("nodes"),
                       *([] if counts is not None else [F.max("n").alias("n")])))
        if counts is not None:
            blocks, counts = blocks.join(counts, "key"), None
        blocks = shared_table(blocks, f"merkle-{len(stored)}")
        stored.append(blocks)
        climbed = sum(F.when(F.col("n") > FANOUT ** k, 1).otherwise(0) for k in range(EVERY))
        above = blocks.select("key", F.col("block").alias("idx"),
                              F.ceil(F.col("n") / F.pow(F.lit(float(FANOUT)), climbed)).cast("long").alias("left"),
                              _levels(F.col("nodes.h"), F.col("n"), lambda ls: ls[-1][0]).alias("h"))
        if (blocks.agg(F.max("n")).first()[0] or 1) <= size:
            return Tree(stored, above.select("key", "h"))
        nodes = above.withColumnRenamed("left", "n")


def extract_paths(tree: Tree, upper: DataFrame) -> DataFrame:
    """Every leaf (key, idx, payload) with its ``path``: per level from the leaf to the root
    the siblings before (``l``) and after it (``r``), as joined hex digests.

    ``upper``: key, path (from the key's root on) and any columns to pass down.
    """
    passed = [c for c in upper.columns if c not in ("key", "path")]
    way = upper.withColumn("idx", F.lit(0).cast("long"))
    for blocks in reversed(tree.stored):
        met = blocks.join(way.withColumnRenamed("idx", "block").withColumnRenamed("path", "above"), ["key", "block"])

        def step(level, i, k, n):
            at = F.floor(i / FANOUT ** k).cast("int")
            inside = at % FANOUT
            return F.when(n > FANOUT ** k, F.struct(_join(F.slice(level, at - inside + 1, inside)).alias("l"),
                                                    _join(F.slice(level, at + 2, FANOUT - 1 - inside)).alias("r")))

        def paths(levels):
            n = F.col("n")
            return F.transform(F.col("nodes"), lambda x, i: F.struct(
                x.alias("x"), F.filter(F.array(*[step(levels[k], i, k, n) for k in range(EVERY)]), lambda s: s.isNotNull()).alias("own")))

        rows = met.select("key", *passed, "above", F.explode(_levels(F.col("nodes.h"), F.col("n"), paths)).alias("e"))
        way = rows.select("key", "e.x.*", F.concat("e.own", "above").alias("path"), *passed)
        if blocks is not tree.stored[0]:
            way = way.select("key", "idx", "path", *passed)
    return way


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return _join(F.transform(path, lambda s: F.concat(s["l"], s["r"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


@dataclass
class Manifest:
    groups: Tree                # leaves are rows: id, h and the payload of ``build_manifest``
    top: Tree                   # leaves are subroots


def build_manifest(docs: DataFrame, leaf: Column, group: Column, key: str = "doc_id", **payload: Column) -> Manifest:
    """Trees over the rows of ``docs``; ``payload``: columns to keep beside each leaf."""
    rows = shared_table(docs.select(group_key(group).alias("key"), F.col(key).alias("id"), leaf.alias("h"),
                                    *[c.alias(k) for k, c in payload.items()]), "merkle-leaves")
    # equal rows are interchangeable: their place in the files spreads them over the ranges
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    numbered = global_row_number(rows, ["id", "h", "tie"], ["key"], out="idx").withColumn("idx", F.col("idx") - 1).drop("tie")
    groups = build_tree(numbered)
    subroots = global_row_number(groups.roots, ["key"], out="idx").select(
        F.lit("").alias("key"), (F.col("idx") - 1).alias("idx"), "h", F.col("key").alias("group"))
    return Manifest(groups, build_tree(subroots))


def proofs(manifest: Manifest) -> DataFrame:
    """Every row: key, idx, id, h (its leaf), payload, path, subroot and root."""
    none = F.array().cast("array<struct<l:string,r:string>>")
    top = extract_paths(manifest.top, manifest.top.roots.select("key", none.alias("path"), F.col("h").alias("root")))
    upper = top.select(F.col("group").alias("key"), "path", F.col("h").alias("subroot"), "root")
    return extract_paths(manifest.groups, shared_table(upper, "merkle-subroots"))


def fields_of(docs: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col(c)) for c in FIELDS]


LOWERED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tamper_audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` against rows altered after it was written.

    Where 3 divides crc32(doc_id) the text is read with its A-Z lower-cased; each row's leaf
    as read now and its stored siblings are folded to a root and held against the manifest's.
    """
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                     leaf_of(*fields_of(docs, text=F.translate("text", *LOWERED))))
    m = build_manifest(docs, leaf_of(*fields_of(docs)), F.col("lang"), altered=altered)
    out = proofs(m).select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root",
                           digest(proof_text(F.col("path"))).alias("proof_sha256"),
                           fold(F.coalesce("altered", "h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
