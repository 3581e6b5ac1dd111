"""Best-fit packing of tokenised documents by a configuration linear program.

Documents are tokenised whole and only those longer than a sequence are cut.  What is left
to decide depends on the histogram of piece lengths alone (at most ``size`` numbers, so it
is solved on the driver whatever the corpus): minimise the number of sequences over
configurations (multisets of lengths that fit), covering every length's count.  The
program is solved by multiplicative weights: each step prices lengths by how far they lag
behind and takes the best configuration by a knapsack dynamic program; the fractions are
rounded up while pieces are left, and what remains is filled by exact subset sums, largest
piece first.

Pieces then find their sequence by their rank among the pieces of their length.  Ranks are
prefix sums over about sqrt(n) buckets per length, so a length that a third of all pieces
share is spread over many tasks.
"""

from __future__ import annotations

import contextlib
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import arrow_rows, shared_table, sqrt_buckets
from missive.llm.words import find_words, word_hashes
from missive.session import ship_package

SIZE = 2048
CACHE = 400_000      # distinct words of one of the two generations a task keeps tokenised


_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_chars() -> dict[int, int]:
    """Byte-level tokenizers write a byte that is not a printable Latin-1 sign as the next
    free character from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class WordTokens:
    """Token ids of texts by a tokenizer that never joins words across ASCII blanks.

    Each distinct blank-separated word is tokenised once and its ids are kept as bytes, in
    two generations: a full one becomes the old one, from which words still in use move on.
    What is forgotten changes nothing but the time.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), cache, {}
        self.ids: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}
        with contextlib.suppress(AttributeError):      # only speed: its own cache is not needed beside this one
            self.tokenizer.model._resize_cache(0)
        self._learn_all([b",", b"."])
        self.marks = {"": b"", ",": self.known[b","], ".": self.known[b"."]}

    def _learn(self, new: list[bytes]) -> None:
        """Tokenise new words.

        A word of plain Latin letters (all of them composed, so that lower-casing is the
        whole normalisation) and at most one mark after it goes to the tokenizer's model
        directly, once for all its spellings.  Other words go through the whole tokenizer,
        many at a time, joined by blanks; the tokens' places tell them apart.
        """
        known, model, hard = self.known, self.tokenizer.model.tokenize, []
        for w in new:
            plain = _PLAIN.fullmatch(w.decode("utf-8"))
            if plain is None:
                hard.append(w)
                continue
            low = plain[1].lower()
            core = low.encode("utf-8")
            ids = known.get(core)
            if ids is None:                              # ASCII letters stand for themselves
                found = [t.id for t in model(low if low.isascii() else core.decode("latin-1").translate(_BYTE_CHARS))]
                ids = known[core] = struct.pack(f"<{len(found)}I", *found)
            if w != core:
                known[w] = ids + self.marks[plain[2]]
        self._learn_all(hard)

    def _learn_all(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 1024):
            part = [w.decode("utf-8") for w in new[i:i + 1024]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in part])))
            cut = (4 * np.searchsorted(first, begin)).tolist()
            for w, a, b in zip(new[i:i + 1024], cut, cut[1:]):
                self.known[w] = ids[a:b]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian.  Words are told apart by 64-bit hashes; ids are
        looked up once per distinct word and gathered for all places at once."""
        data = b"".join(texts)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        buf = np.frombuffer(data, np.uint8)
        starts, ends, first = find_words(buf, off)
        if starts.size == 0:
            return [b""] * len(texts)
        keys, at, inverse = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.ids) > self.limit:
            self.ids, self.before = {}, self.ids
        if len(self.known) > self.limit:
            self.known = {}
        found = keys.tolist()
        new = [i for i, k in enumerate(found) if k not in self.ids]
        old = [i for i in new if found[i] in self.before]
        self.ids.update((found[i], self.before[found[i]]) for i in old)
        new = [i for i in new if found[i] not in self.ids]
        if new:
            a, b = starts[at[new]].tolist(), ends[at[new]].tolist()
            words = [data[x:y] for x, y in zip(a, b)]
            self._learn([w for w in words if w not in self.known])
            self.ids.update(zip(map(found.__getitem__, new), map(self.known.__getitem__, words)))
        ids = list(map(self.ids.__getitem__, found))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[inverse]
        upto = np.concatenate(([0], np.cumsum(n)))
        tokens = flat[np.repeat(begin[inverse] - upto[:-1], n) + np.arange(upto[-1])]
        cut = upto[first].tolist()
        return [tokens[x:y].tobytes() for x, y in zip(cut, cut[1:])]


_LOADED: dict[str, WordTokens] = {}


def _loaded(path: str) -> WordTokens:
    """One table of known words per Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def _pieces(tokenizer: str, size: int, with_ids: bool):
    def run(batches):
        tokens = _loaded(tokenizer)
        for batch in batches:
            texts = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(texts):                       # a few MB of whole texts at a time
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= 2 << 20):
                    held += len(texts[end])
                    end += 1
                rows = []
                for one, data in zip(ids[at:end], tokens.encode(texts[at:end])):
                    data += b"\0\0\0\0"
                    for k in range(0, len(data) // 4, size):
                        part = data[4 * k:4 * (k + size)]
                        rows.append((one, k // size, k, len(part) // 4, zlib.crc32(part), part))
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
                cols += [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
                if with_ids:
                    flat = np.frombuffer(b"".join(r[5] for r in rows), "<u4").astype(np.int32)
                    off = np.concatenate(([0], np.cumsum([r[3] for r in rows]))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
                at = end
    return run


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """Copies of each length in the configuration of highest price (any number of each)."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    price = np.full(size + 1, -np.inf)
    price[lengths] = prices
    for c in range(int(lengths[0]), size + 1):
        v = best[:c][::-1] + price[1:c + 1]              # the piece of length k + 1 goes last
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], pick[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    a, c = np.zeros(lengths.size, np.int64), size
    while c > 0:
        if pick[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        a[np.searchsorted(lengths, pick[c])] += 1
        c -= int(pick[c])
    return a


def fill(lengths: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """A configuration of the pieces left: the largest one, and of the others an exact
    subset sum that leaves the smallest gap (bit sets over the room)."""
    a = np.zeros(lengths.size, np.int64)
    top = int(np.flatnonzero(left)[-1])
    a[top] = 1
    room = size - int(lengths[top])
    rest = left.copy()
    rest[top] -= 1
    items = [(int(lengths[j]), int(j)) for j in np.flatnonzero(rest)[::-1] if lengths[j] <= room]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, j in items:
        have, n = 1, min(int(rest[j]), room // length)
        while n > 0:                                     # copies by doubling
            take = min(have, n)
            steps.append((reach, length * take, j, take))
            reach |= (reach << (length * take)) & mask
            n -= take
            have *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for before, weight, j, take in reversed(steps):
        if not before >> at & 1:
            a[j] += take
            at -= weight
    return a


def fractions(lengths: np.ndarray, counts: np.ndarray, size: int, epsilon: float = 0.05,
              rounds: int = 3) -> tuple[dict[bytes, float], np.ndarray]:
    """Multiplicative weights: amounts of configurations and how often they cover each length.

    A length's price starts a little above the room it takes (so that full configurations
    of long pieces, the hard ones, come first) and falls as the length is covered; each step
    takes the best configuration until its scarcest length is covered once more, so no step
    covers any length more than once.  It ends when every length is covered ``rounds`` times, at
    the latest after two steps per length (the lengths bound it, not the counts); the amounts
    are scaled by the least coverage."""
    price, covered = (lengths / size) ** 1.1, np.zeros(lengths.size)
    amounts: dict[bytes, float] = {}
    for _ in range(2 * lengths.size):
        a = knapsack(lengths, price, size)
        used = a > 0
        step = float((counts[used] / a[used]).min())
        amounts[a.tobytes()] = amounts.get(a.tobytes(), 0.0) + step
        share = a * step / counts
        covered += share
        price = price * np.exp(-epsilon * share)
        price /= price.max()
        if covered.min() >= rounds:
            break
    scale = max(1.0, float(covered.min()))
    return {k: x / scale for k, x in amounts.items()}, covered / scale


def rounded(lengths: np.ndarray, counts: np.ndarray, size: int, amounts, gap: int, part: float = 1.0) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Whole copies (``part`` of the amounts rounded up, as far as pieces are left) of the
    configurations with at most ``gap`` unused, the largest amounts first; what they leave is
    filled by exact subset sums.  Also the number of sequences from the program."""
    left, out, n = counts.copy(), [], 0
    for key, x in sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0])):
        a = np.frombuffer(key, np.int64)
        used = a > 0
        copies = int(min(np.ceil(x * part), (left[used] // a[used]).min()))
        if copies > 0 and size - int(a @ lengths) <= gap:
            left -= a * copies
            out.append((a, copies))
            n += copies
    while left.any():                                   # each turn uses up a length
        a = fill(lengths, left, size)
        used = a > 0
        copies = int((left[used] // a[used]).min())
        left -= a * copies
        out.append((a, copies))
    return out, n


def solve(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with their numbers of copies that use up all counts exactly."""
    return _solve(lengths, counts, size)[0]


def _solve(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[list[tuple[np.ndarray, int]], int, int]:
    """(plan, sequences, sequences from the program): of the roundings (a small gap or none;
    all of the amounts, or less so that the filler has more to choose from) the one with fewest
    sequences, then with most from the program.  The subset-sum filler alone is the last
    resort: the total never exceeds it."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if lengths.size == 0:
        return [], 0, 0
    amounts, _covered = fractions(lengths, counts, size)
    best = None
    for chosen, gap, part in ((amounts, size // 256, 1.0), (amounts, 0, 1.0), (amounts, 0, 0.8), (amounts, 0, 0.6), ({}, 0, 1.0)):
        plan, n_program = rounded(lengths, counts, size, chosen, gap, part)
        score = (sum(m for _, m in plan), -n_program)
        if best is None or score < best[0]:
            best = score, plan
    return _plan(lengths, best[1]), best[0][0], -best[0][1]


def _plan(lengths: np.ndarray, configs) -> list[tuple[np.ndarray, int]]:
    return [(np.stack([lengths[a > 0], a[a > 0]]), m) for a, m in configs]


def segments(plan) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for config, copies in plan:
        offset = 0
        for length, n in config.T[::-1].tolist():
            first = used.get(length, 0)
            rows.append((length, first, copies, base, offset))
            used[length] = first + n * copies
            offset += n * length
        base += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    keys = (table[:, 0] << 40) + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            k = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(row[:, 3] + k % row[:, 2]), pa.array(row[:, 4] + k // row[:, 2] * length)],
                                             names=names + ["sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, (``ids``,) ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file (default: the public word BPE).  Each
    document is its ids and one closing id 0; null and empty texts are the closing id
    alone.  Repeated rows and null ids are packed as often as they occur.  An empty table
    gives no row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pieces(str(tokenizer), size, with_ids), schema)
    pieces = shared_table(pieces, "pk-pieces")
    hist = pieces.groupBy("length").count().collect()       # at most ``size`` rows
    table = segments(solve(np.array([r["length"] for r in hist]), np.array([r["count"] for r in hist]), size))
    buckets = sqrt_buckets(sum(r["count"] for r in hist))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = shared_table(per.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "pk-buckets")
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("nth", F.row_number().over(inside)).join(per, ["length", "bucket"])
              .withColumn("rank", (F.col("before") + F.col("nth") - 1).cast("long")).select(*pieces.columns, "rank"))
    out = ranked.mapInArrow(_place(table), schema + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows of ``pack(..., with_ids=True)`` to whole sequences: sequence_id, ids, length."""
    part = F.struct("offset", "ids")
    return (pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")).withColumn("length", F.size("ids")))
