"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of one dimension are grouped by norm, a factor of 2 to each group, so that a few long ones don't press the
others together. Inner products become distances by scaling with the group's largest norm and one added coordinate.
In each group, each of ``tables`` tables hashes a vector to ``k`` values ``floor((a x + b) / w)`` with Gaussian ``a``. A query visits its own bucket and
perturbed ones in order of estimated success (the sum of squared distances to the bucket borders crossed). How fine
buckets are and how many a query visits is fitted on a bounded pilot sample of the group's vectors: where neighbours
stand out, few vectors are compared; where all vectors are about equally far from each other, no hashing can tell
neighbours from others, and most are. Buckets
are dealt to shards of bounded size; a bucket larger than a shard is cut into parts that all its visitors see, so
that none is capped. A shard compares its visitors with their buckets as matrices and returns each visitor's best;
the tables' candidates are then merged. Queries that meet fewer than they could are compared with all vectors, in
blocks. Scores are exact inner products in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .jaccard import _grouped
from .text import U64, mix

#: Groups of at most so many vectors are searched in full.
FULL = 256
#: Pilot sample: vectors of a group and values in all, groups that have one (the largest), queries, the recall that it must
#: reach, and the numbers of hash values that are tried beyond the usual one, finest first.
PILOT, PILOT_VALUES, PILOT_GROUPS, PILOT_QUERIES, PILOT_RECALL, FINER = 2048, 2_000_000, 4, 24, 0.95, (12, 9, 7, 6, 5, 4)
#: Probes that are tried with finer hashing than usual; where more would be needed, coarser buckets cost less.
FINER_PROBES = 192
#: Vectors of a shard, about, and at most so many buckets that are larger than one (8 bytes each, broadcast).
SHARD, MAX_LARGE = 32_768, 100_000


@lru_cache(maxsize=64)
def _directions(dim: int, table: int, k: int, w: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20_240_701, dim, table])
    return rng.normal(size=(dim + 1, k)), rng.uniform(0, w, k)


def _key(buckets: np.ndarray, group: int, table: int) -> np.ndarray:
    """A 64-bit name for each row of bucket coordinates."""
    h = np.full(len(buckets), (group << 8) + table, U64)
    for c in buckets.T:
        h = mix(h * U64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(U64))
    return h.view(np.int64)


def perturbations(inside: np.ndarray, w: float, probes: int) -> np.ndarray:
    """Bucket offsets to visit, most promising first. ``inside``: distances to the lower borders (0 to w)."""
    k = len(inside)
    cost = np.concatenate([inside, w - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    cost, dim = cost[order], order % max(k, 1)
    sign = np.where(order < k, -1, 1)
    out, heap = [np.zeros(k, np.int64)], [(cost[0], (0,))] if k else []
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({dim[i] for i in chosen}) == len(chosen):
            move = np.zeros(k, np.int64)
            move[dim[list(chosen)]] = sign[list(chosen)]
            out.append(move)
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


def probes_for(k: int) -> int:
    """Buckets to visit in each table: twice as many with every value beyond the fifth, as each makes buckets smaller."""
    return 64 << max(0, k - 5)


def long_form(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Stored vectors, scaled by the group's longest, or queries (no ``longest``), with the coordinate that makes inner
    products into distances."""
    size = np.sqrt((x * x).sum(axis=1))
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))
    return np.column_stack([x / (size[:, None] if longest is None else longest), more])


def fitted(sample: np.ndarray, n: int, least: int, top: int, tables: int, w: float) -> tuple[int, int, float]:
    """``k``, ``probes`` and the share of vectors that a query meets with them, judged on a sample of a group of ``n``.

    ``k`` is at least ``least``. Of the finest hashing that reaches PILOT_RECALL the fewest probes are taken; without one,
    ``least`` and its default probes. A sample's nearest are farther off than those of the whole group: it errs towards
    more probes."""
    m, dim = sample.shape
    longest = float(np.sqrt((sample * sample).sum(axis=1)).max()) or 1.0
    asked = np.linspace(0, m - 1, min(m, PILOT_QUERIES)).astype(int)
    score = np.einsum("id,jd->ij", sample[asked], sample)
    score[np.arange(len(asked)), asked] = -np.inf
    wanted = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(m - 1, round(top * m / n)))]
    stored, query = long_form(sample, longest), long_form(sample[asked], None)
    for k in [k for k in FINER if k > least] + [least]:
        most = probes_for(k) if k == least else min(probes_for(k), FINER_PROBES)
        first = np.full((len(asked), m), most)
        for t in range(tables):
            a, b = _directions(dim, t, k, w)
            keys = _key(np.floor((np.einsum("id,dk->ik", stored, a) + b) / w), 0, t)
            at = (np.einsum("id,dk->ik", query, a) + b) / w
            own = np.floor(at)
            for i in range(len(asked)):
                visit = _key(own[i] + perturbations((at[i] - own[i]) * w, w, most), 0, t)
                order = np.argsort(visit, kind="stable")
                spot = np.minimum(np.searchsorted(visit[order], keys), len(visit) - 1)
                hit = visit[order][spot] == keys
                first[i, hit] = np.minimum(first[i, hit], order[spot[hit]])
        best = np.take_along_axis(first, wanted, axis=1)
        p = 1
        while p <= most:
            if (best < p).mean() >= PILOT_RECALL:
                return k, p, float((first < p).mean())
            p += max(1, p // 4)
        if k == least:
            return k, most, float((first < most).mean())


def usable(v: Column) -> Column:
    """Vectors that take part: no null, no component null or not finite, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def pilots(rows: DataFrame, largest: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int], np.ndarray, int]]:
    """Dimension and band, sample and size of groups (``count, dimension, band``): vectors of the smallest id hashes, about
    PILOT of a group and PILOT_VALUES numbers in all."""
    chosen = [(c, d, b) for c, d, b in largest if c]
    share = None
    for count, dim, band in chosen:
        want = min(PILOT, max(64, PILOT_VALUES // (len(chosen) * dim)))
        below = F.lit(min(1 << 30, -(-(want << 30) // count)))
        here = (F.size("v") == dim) & (F.col("band") == band)
        share = F.when(here, below) if share is None else share.when(here, below)
    if share is None:
        return
    found: dict[tuple[int, int], list] = {}
    for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select(F.size("v").alias("dim"), "band", "v").collect():
        found.setdefault((r["dim"], r["band"]), []).append(r["v"])
    for count, dim, band in chosen:
        if len(held := found.get((dim, band), [])) > 1:
            yield (dim, band), np.array(held, float), max(count, len(held))


def nearest(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, top: int = 20, tables: int = 5, k: int | None = None, w: float = 1.5, probes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest found for every row where ``is_query``.

    Candidates are all other usable rows of the same dimension; a query gets ``top`` of them, or all if there are
    fewer. ``k`` is by default at least the rounded decimal logarithm of a group's size (0, a full search, up to 256) and
    ``probes`` at most ``probes_for`` of it; a pilot sample of the largest groups makes ``k`` larger and ``probes``
    smaller where that keeps recall (``fitted``). Ties go to the smaller id; rows of null id take no part; of rows with one id and different vectors each is a candidate and the
    best counts. An empty table gives no rows.
    """
    v = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.coalesce(F.log2(norm), F.lit(-500.0))))  # norms may leave the doubles
    rows = rows.withColumn("band", F.floor(size + 0.5).cast("int"))
    groups: dict[int, dict[int, tuple[int, int, int, float]]] = {}  # dimension, band: number, k, probes, largest norm
    sizes: list[tuple[int, int, int]] = []
    n = stored = number = 0
    for dim, of_dim in groupby(rows.groupBy(F.size("v"), "band").agg(F.count("*"), F.max(norm)).sort(F.size("v"), "band").collect(), lambda r: r[0]):
        bands, small = groups.setdefault(dim, {}), None
        for _, band, count, longest in of_dim:
            here = k if k is not None else 0 if count <= FULL else max(2, round(float(np.log10(count))))
            if here == 0:  # all of them are one group
                small = number if small is None else small
            group = small if here == 0 else number
            number += group == number
            bands[band] = (group, here, probes_for(here) if probes is None else probes, min(longest, 2.0**501) or 1.0)
            n, stored = n + count, stored + count * (tables if here else 1)
            sizes.append((count if here else 0, dim, band))
    if k is None and probes is None:
        for (dim, band), sample, count in pilots(rows, sorted(sizes, reverse=True)[:PILOT_GROUPS]):
            group, least, _, longest = groups[dim][band]
            finer, fewer, _ = fitted(sample, count, least, top, tables, w)
            groups[dim][band] = (group, finer, fewer, longest)
    part = max(SHARD, -(-stored // MAX_LARGE))
    shards = max(1, -(-stored // part))

    def columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Positions, vectors and dimension, dimension by dimension."""
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()  # of this slice only
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            yield at, flat[begin[at][:, None] + np.arange(dim)], dim

    def hashed(x: np.ndarray, dim: int, k: int, longest: float | None) -> Iterator[tuple[int, np.ndarray]]:
        """Table by table; queries have no ``longest``. A full search needs one table."""
        long = long_form(x, longest)
        for t in range(tables if k else 1):
            a, b = _directions(dim, t, k, w)
            yield t, (long @ a + b) / w

    def stored_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, vectors and keys of stored vectors, group by group and table by table."""
        band_of = batch.column(2).to_numpy()
        for at, x, dim in columns(batch):
            for band in np.unique(band_of[at]).tolist():
                some = band_of[at] == band
                group, k, _, longest = groups[dim][band]
                for t, h in hashed(x[some], dim, k, longest):
                    yield at[some], x[some], _key(np.floor(h), group, t)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key in stored_keys(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    large = {}
    if n:
        counts = rows.select("id", "v", "band").mapInArrow(keys_of, "key long").groupBy("key").count().where(F.col("count") > part)
        first = shards
        for key, count in sorted((r[0], r[1]) for r in counts.collect()):  # at most MAX_LARGE rows
            cuts = -(-count // part)
            large[key] = (first, cuts)
            first += cuts
    dealt = vectors.sparkSession.sparkContext.broadcast(large)

    def shard_of(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = (key.view(U64) % U64(shards)).astype(np.int64)
        for i in np.flatnonzero(np.isin(key, np.fromiter(dealt.value, np.int64, len(dealt.value)))) if dealt.value else ():
            base, cuts = dealt.value[int(key[i])]
            out[i] = base + int(mix(ids[i : i + 1].astype(np.int64).view(U64))[0] % U64(cuts))
        return out

    def dealer(query: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not query:
                    ids = batch.column(0).to_numpy()
                    for at, x, key in stored_keys(batch):
                        yield out(shard_of(key, ids[at]), 0, [key[i : i + 1] for i in range(len(at))], ids[at], x)
                    continue
                some = [batch.slice(c, 256) for c in range(0, batch.num_rows, 256)]  # a query goes to many shards
                for ids, (at, x, dim) in ((b.column(0).to_numpy(), c) for b in some for c in columns(b)):
                    visits: dict[tuple[int, int], list] = {}
                    for group, k, probes in sorted({g[:3] for g in groups[dim].values()}):
                        for t, h in hashed(x, dim, k, None):
                            own = np.floor(h)
                            for i in range(len(at)):
                                move = perturbations((h[i] - own[i]) * w, w, probes)
                                key = _key(own[i] + move, group, t)
                                for s, one in zip((key.view(U64) % U64(shards)).tolist(), key.tolist(), strict=True):
                                    base, cuts = dealt.value.get(one, (s, 1))
                                    for c in range(cuts):
                                        visits.setdefault((i, base + c), []).append(one)
                    who = np.array([i for i, _ in visits], np.int64)
                    yield out(np.array([s for _, s in visits]), 1, [np.array(v, np.int64) for v in visits.values()], ids[at][who], x[who])

        return deal

    def out(shard, kind: int, keys: list[np.ndarray], ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.full(len(ids), kind, np.int32)), lists, pa.array(ids, pa.int64()), values], names=["shard", "kind", "keys", "id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, 1):
            kinds = np.concatenate([b.column(1).to_numpy() for b in held])
            queries = int((kinds == 1).sum())
            if not queries or queries == len(kinds):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["id"].to_numpy()
            lists, values = (table[c].combine_chunks() for c in ("keys", "v"))
            lists, values = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, values))
            count, sizes = np.diff(lists.offsets.to_numpy()), np.diff(values.offsets.to_numpy())
            flat, begin = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            keys, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), count)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            found_q, found_x, found_s = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = owner[a:b]
                qs, xs = mine[kinds[mine] == 1], mine[kinds[mine] == 0]
                if not len(qs) or not len(xs):
                    continue
                dim = int(sizes[xs[0]])
                x = flat[begin[xs][:, None] + np.arange(dim)]
                for c in range(0, len(qs), 512):
                    some = qs[c : c + 512]
                    q = flat[begin[some][:, None] + np.arange(dim)]
                    score = q @ x.T
                    score[ids[some][:, None] == ids[xs][None, :]] = -np.inf
                    least = np.partition(score, len(xs) - top, axis=1)[:, len(xs) - top] if len(xs) > top else np.full(len(some), -np.inf)
                    r, col = np.nonzero((score >= least[:, None] - 1e-9) & (score > -np.inf))
                    exact = np.zeros(len(r))
                    for d in range(dim):  # one order of summation: equal vectors get equal scores
                        exact += q[r, d] * x[col, d]
                    found_q.append(some[r])
                    found_x.append(ids[xs[col]])
                    found_s.append(exact)
            if not found_q:
                continue
            q, x, s = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
            order = np.lexsort((x, -s, q))
            q, x, s = q[order], x[order], s[order]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (x[1:] != x[:-1])])  # tables meet in a shard
            q, x, s = q[new], x[new], s[new]
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            keep = place < top
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(x[keep]), pa.array(s[keep])], names=["query_id", "vec_id", "score"])

    def block(query: bool, across: int, down: int):
        """Vectors to one of ``across`` blocks in each of ``down`` rows of blocks, queries the other way round."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                place = mix(ids.astype(np.int64).view(U64))
                for at, x, dim in columns(batch):
                    own = (place[at] % U64(down if query else across)).astype(np.int64)
                    for other in range(across if query else down):
                        shard = own * across + other if query else other * across + own
                        yield out(shard, int(query), [np.array([dim], np.int64)] * len(at), ids[at], x)

        return deal

    kind = "shard long, kind int, keys array<long>, id long, v array<double>"
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(data: DataFrame, asked: DataFrame) -> DataFrame:
        both = data.union(asked).repartition(max(parts, 1), "shard").sortWithinPartitions("shard")
        found = both.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    asked = rows.where("q").select("id", "v")
    found = searched(rows.select("id", "v", "band").mapInArrow(dealer(False), kind), asked.mapInArrow(dealer(True), kind))
    hashed_dims = [dim for dim, bands in groups.items() if any(g[1] for g in bands.values())]
    if not hashed_dims:
        return found
    found = scratch.written(found, "nearest")
    enough = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= top)
    ids = asked.where(F.size("v").isin(hashed_dims)).select("id").distinct().join(enough, "id", "left_anti")
    short = scratch.written(asked.join(ids, "id", "left_semi"), "short")
    m = short.count()
    if not m:
        return found
    across, down = max(1, -(-n // SHARD)), max(1, -(-m // SHARD))
    dims = [r[0] for r in short.select(F.size("v")).distinct().collect()]
    scanned = searched(rows.where(F.size("v").isin(dims)).select("id", "v").mapInArrow(block(False, across, down), kind), short.mapInArrow(block(True, across, down), kind))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(scanned)
