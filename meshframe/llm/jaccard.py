"""Exact n-gram Jaccard join with set-relation skipping.

Two sets link when ``den * |a & b| >= num * |a | b|``. Steps, all distributed:

1. *Order.* Shingles that are frequent (found exactly within chunks of 4 million shingles, summed over all
   chunks) come last in a global order, the others first by hash. Any order gives right results; this one keeps
   index lists short.
2. *Sets.* Equal sets collapse into one class by a 128-bit fingerprint; a class is represented by its smallest
   document. Copies are never expanded.
3. *Index.* A set's prefix (the ``n - ceil(num * n / den) + 1`` lowest shingles) is indexed. Lists of one entry
   are dropped; the others are cut into blocks of sizes a factor ``num / den`` apart, and a set stands in the block
   of its own size and visits the next one. An entry skips that visit when its position in the set rules it out:
   from position ``i`` on, ``n - i`` shingles are left, which must suffice for the overlap with the larger set.
   Every linked pair shares a block (that of its first common shingle, at the larger set's size).
4. *Groups.* The members of a block form a group under the block's smallest member: one row per member, so that
   rows grow with members and not with pairs. Groups over a bound of members or shingles are cut into chunks
   and every pair of chunks becomes a task of its own.
5. *Sifting.* What two prefixes share bounds what their sets can share. A group's members are first compared on
   prefixes alone; only those with a possible partner have their texts sent to it.
6. *Answers.* A group compares all members with its leader; the leader's answer then settles the members it
   links. Answers for pairs that are left open are derived from the leader's: two sets share what the leader's
   answers say, corrected by what both lack of the leader and by what both have beyond it. Only these differences
   are compared, size block by size block. A task returns a spanning forest of the links it found, never all pairs.
7. *Components* of classes by large-star and small-star rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .text import U64, blocks, rolling, shingles

#: Shingles that are counted exactly together, and how often one must occur there to be called frequent.
CHUNK, FREQUENT = 4_000_000, 3
#: Bound on the frequent shingles that are sent to the tasks (8 bytes each); only the order depends on it.
MAX_FREQUENT = 250_000
#: Members and shingles of a group, or of a chunk of one, that a task holds at once.
GROUP_MEMBERS, GROUP_SHINGLES = 2048, 1_500_000


def frequent_shingles(texts: DataFrame, k: int, lower: bool) -> np.ndarray:
    """Hashes of frequent shingles, rarest first, at most ``MAX_FREQUENT``; every text is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, _ = block.words()
                held.append(rolling(block.word_hashes(starts, ends, lower), k))
                size += len(held[-1])
                if size >= CHUNK:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    counts = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).toArrow()
    return np.ascontiguousarray(rows["h"].to_numpy()[::-1]).view(U64)


def ordered_sets(docs: DataFrame, k: int, num: int, den: int, lower: bool = True) -> DataFrame:
    """``doc_id, n, cid, toks``: set size, fingerprint of the set (null when empty) and its prefix."""
    spark = docs.sparkSession
    common = frequent_shingles(docs, k, lower)
    rank = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[rank], rank))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                sizes, cids, toks, lens = [], [], [], []
                for _, h in shingles(block, k, lower):
                    n = len(h)
                    sizes.append(n)
                    cids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if n else None)
                    p = n - -(-num * n // den) + 1 if n else 0
                    if n and len(known):
                        at = np.searchsorted(known, h)
                        at[at == len(known)] = 0
                        seen = known[at] == h
                        h = np.concatenate([h[~seen], h[seen][np.argsort(place[at[seen]])]])[:p] if seen.any() else h[:p]
                    else:
                        h = h[:p]
                    toks.append(h)
                    lens.append(p)
                offsets = np.zeros(len(lens) + 1, np.int32)
                np.cumsum(lens, out=offsets[1:])
                flat = np.concatenate(toks).view(np.int64) if toks else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.rows.start, len(block.rows)), pa.array(sizes, pa.int64()), pa.array(cids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "n", "cid", "toks"],
                )

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n long, cid binary, toks array<long>")


def _classes(n: Column, num: int, den: int) -> Column:
    """Size class: linked sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(den / num))) + 1e-9).cast("int")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def joined(sets: list[np.ndarray], size: np.ndarray, hit: Callable, num: int, den: int, rows: int = 256, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` (sorted distinct hashes) for which ``hit(inter, i, j)`` holds.

    ``size`` are the sizes that rule pairs out (``den * smaller < num * larger``). The leader ``L`` is the first set; its
    answers ``|a & L|`` come first. Any other pair's answer follows from two of them and the pair's differences from L:
    ``|a & b| = |a & L| + |b & L| - |L| + |both lack of L| + |both have beyond L|``. Differences are compared in blocks
    of sets ordered by size; blocks are skipped when their sizes rule a pair out or all their sets are joined."""
    m = len(sets)
    if m == 2:
        if den * min(size) < num * max(size):
            return []
        return [(0, 1)] if hit(len(np.intersect1d(sets[0], sets[1], assume_unique=True)), 0, 1) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times[code] > 1  # a shingle of one set only adds to no intersection
    code, owner = code[again], owner[again]
    forest, out = _Forest(m), []
    lead = np.zeros(len(times), bool)
    lead[code[owner == 0]] = True
    inter = np.bincount(owner[lead[code]], minlength=m)
    fits = (den * np.minimum(size, size[0]) >= num * np.maximum(size, size[0])) & hit(inter, 0, np.arange(m))
    for x in np.flatnonzero(fits):
        if x and forest.join(0, int(x)):
            out.append((0, int(x)))
    settled = np.array([forest.find(i) == 0 for i in range(m)])
    if settled.all():
        return out
    by_size = np.argsort(size, kind="stable")
    spot = np.empty(m, np.int64)
    spot[by_size] = np.arange(m)
    # a set as its differences from the leader: shingles of the leader that it lacks, and those that it has beyond
    led = lead[code]
    _, beyond = np.unique(code[~led], return_inverse=True)
    _, known = np.unique(code[led], return_inverse=True)
    n_lead = int(known.max()) + 1 if len(known) else 0
    absent = np.ones((m, n_lead), bool)
    absent[owner[led], known] = False
    lacker, lacked = np.nonzero(absent)
    del absent
    owner, code = np.concatenate([lacker, owner[~led]]), np.concatenate([lacked, n_lead + beyond])
    _, code, times = np.unique(code, return_inverse=True, return_counts=True)
    owner, code = owner[times[code] > 1], code[times[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    width = int(code.max()) + 1 if len(code) else 0
    order = np.argsort(spot[owner], kind="stable")
    code, place = code[order], spot[owner][order]
    first = np.searchsorted(place, np.arange(0, m + rows, rows))
    size_s, settled_s, inter_s = size[by_size], settled[by_size], inter[by_size]
    for a in range(0, m, rows):
        na = min(rows, m - a)
        b = a
        while b < m and den * size_s[a + na - 1] >= num * size_s[b]:  # no larger set can link beyond here
            nb = min(rows, m - b)
            if not (settled_s[a : a + na].all() and settled_s[b : b + nb].all()):
                gram = np.zeros((na, nb), np.float32)
                for c in range(0, width, columns):
                    left = np.zeros((na, min(columns, width - c)), np.float32)
                    right = np.zeros((nb, min(columns, width - c)), np.float32)
                    for grid, at, k in ((left, a, a // rows), (right, b, b // rows)):
                        cc, pp = code[first[k] : first[k + 1]], place[first[k] : first[k + 1]]
                        here = (cc >= c) & (cc < c + columns)
                        grid[pp[here] - at, cc[here] - c] = 1
                    gram += left @ right.T
                sa, sb = size_s[a : a + na, None], size_s[None, b : b + nb]
                both = inter_s[a : a + na, None] + inter_s[None, b : b + nb] - n_lead + gram.astype(np.int64)
                fit = (den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)) & hit(both, by_size[a : a + na, None], by_size[None, b : b + nb])
                for i, j in np.argwhere(fit):
                    x, y = int(by_size[a + i]), int(by_size[b + j])
                    if x != y and forest.join(x, y):
                        out.append((min(x, y), max(x, y)))
            b += nb
    return out


def linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among whole sets."""
    size = np.array([len(s) for s in sets], np.int64)
    return joined(sets, size, lambda inter, i, j: (inter > 0) & (den * inter >= num * (size[i] + size[j] - inter)), num, den)


def possible(prefixes: list[np.ndarray], size: np.ndarray, rest: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link: what their prefixes share, with all of the larger ``rest``
    (shingles beyond the prefix), must reach the overlap that a link needs (a shared one outside of both prefixes is in the rest of the one that ends first)."""
    return joined(prefixes, size, lambda inter, i, j: (inter > 0) & ((num + den) * (inter + np.maximum(rest[i], rest[j])) >= num * (size[i] + size[j])), num, den)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows that agree in the first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            mark = tuple(c[a] for c in columns)
            if mark != key:
                if held:
                    yield key, held
                key, held = mark, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def jaccard_links(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int, lower: bool = True) -> DataFrame:
    """``a, b``: links between representatives of distinct sets whose components are those of all links."""
    reps = sets.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    own = sets.join(reps, ["cid", "doc_id"], "left_semi").dropDuplicates(["doc_id", "cid"])
    cut = _classes(F.col("n"), num, den)
    largest = F.floor((F.col("n") - F.col("i")) * (num + den) / num - F.col("n") + 1e-6)  # that an entry at i can link with
    visits = F.coalesce((largest > F.col("n")) & (_classes(largest, num, den) > cut), F.lit(False))
    posts = own.select(F.posexplode("toks").alias("i", "tok"), F.col("doc_id").alias("x"), "n")
    posts = posts.select("tok", "x", (2 * F.col("n") + visits.cast("long")).alias("nv"))  # one number: both uses below read one shuffle
    lists = posts.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1").select("tok")
    listed = posts.join(lists, "tok")
    entries = listed.select("tok", "x", F.expr("nv div 2").alias("n"), (F.col("nv") % 2 == 1).alias("visits"))
    entries = entries.select("tok", "x", "n", F.explode(F.when(F.col("visits"), F.array(cut, cut + 1)).otherwise(F.array(cut))).alias("g"), cut.alias("home"))
    blocks_ = entries.groupBy("tok", "g").agg(F.min("x").alias("l"), F.count("*").alias("m"), F.max(F.col("g") == F.col("home")).alias("h")).where("m > 1 and h").select("tok", "g", "l")
    members = scratch.written(entries.join(blocks_, ["tok", "g"]).select("l", "g", "x", "n").distinct(), "members")
    groups = members.groupBy("l", "g").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    chunks = F.greatest(F.ceil(F.col("m") / GROUP_MEMBERS), F.ceil(F.col("s") / GROUP_SHINGLES), F.lit(1)).cast("int")
    sized = members.join(groups.select("l", "g", chunks.alias("c")), ["l", "g"])
    chunk = F.when(F.col("c") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("x"), F.col("c")).cast("int"))
    other = F.sequence(F.lit(0), F.col("c") - 1)
    dealt = sized.withColumn("i", chunk).select("l", "g", "x", "i", F.explode(other).alias("j")).select("l", F.col("g").cast("long").alias("g"), "x", F.least("i", "j").cast("long").alias("ci"), F.greatest("i", "j").cast("long").alias("cj"))
    keys = ["l", "g", "ci", "cj"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a shingle that only one set indexes adds to no intersection: prefixes are sent without those
    shared_toks = listed.groupBy("x").agg(F.collect_list("tok").alias("toks"), F.expr("first(nv) div 2").alias("n"))
    prefixed = dealt.join(shared_toks.hint("merge"), "x").select(*keys, "x", "n", F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1").alias("p"), "toks")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        for key, rows in _grouped(batches, 4):
            x = np.concatenate([r.column(4).to_numpy() for r in rows])
            n = np.concatenate([r.column(5).to_numpy() for r in rows])
            p = np.concatenate([r.column(6).to_numpy() for r in rows])
            toks = [t.values.to_numpy().view(U64) for r in rows for t in r.column(7)]
            if len(x) < 2:
                continue
            order = np.argsort(x, kind="stable")
            forest = _Forest(len(x))
            for a, b in possible([np.sort(toks[i]) for i in order], n[order], (n - p)[order], num, den):
                forest.join(a, b)
            root = np.array([forest.find(i) for i in range(len(x))])
            for i in np.flatnonzero(np.bincount(root, minlength=len(x))[root] > 1):
                for c, v in zip(out, (*key, x[order[root[i]]], x[order[i]]), strict=True):
                    c.append(v)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[*keys, "root", "x"])
                out = [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[*keys, "root", "x"])

    sifted = prefixed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(sift, "l long, g long, ci long, cj long, root long, x long")
    # groups that differ in their keys only hold the same pairs: a document is sent to each set of companions once
    near = sifted.select("root", "x", F.xxhash64(*keys).alias("k"))
    texts = docs.select(F.col("doc_id").alias("x"), "text")
    near = scratch.written(near, "near")
    alike = near.groupBy("root", "k").agg(F.bit_xor(F.xxhash64("x")).alias("s"), F.count("*").alias("c")).groupBy("root", "s", "c").agg(F.min("k").alias("k"))
    rows = near.join(alike.select("root", "k"), ["root", "k"], "left_semi").hint("merge").join(texts, "x").select("root", "k", "x", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, 2):
            own_sets: dict[int, np.ndarray] = {}
            for batch in held:
                xs = batch.column(2).to_numpy()
                for block in blocks(batch.column(3)):
                    for row, h in shingles(block, k, lower):
                        own_sets.setdefault(int(xs[row]), h)  # repeated rows of a document count once
            order = sorted(own_sets)
            if len(order) > 1:
                found = linked([own_sets[x] for x in order], num, den)
                yield pa.RecordBatch.from_arrays([pa.array([order[a] for a, _ in found], pa.int64()), pa.array([order[b] for _, b in found], pa.int64())], names=["a", "b"])

    return rows.repartition(parts, "root", "k").sortWithinPartitions("root", "k").mapInArrow(compare, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, lower: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Null or wordless texts have no shingles, link with nothing and are their own component; equal texts and
    repeated rows are one class; a null ``doc_id`` takes no part and has a null component. One row per input row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.written(ordered_sets(docs, k, num, den, lower), "sets")
    parts = components(jaccard_links(docs, sets, k, num, den, lower))
    reps = sets.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    label = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("cid", F.coalesce("component", "rep").alias("component_id"))
    told = sets.select("doc_id", "n", "cid").join(label, "cid", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Near-duplicate removal: the rows of ``docs`` whose ``doc_id`` is the smallest of its component stay."""
    kept = jaccard_join(docs, k, num, den).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
