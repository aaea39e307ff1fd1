"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once.

A conversation's path is the list of hashes of its turns. Sorted by path, conversations stand in depth-first
order: each adds to the output only the turns beyond those it shares with its predecessor, which are just the
tree's new nodes. Paths are range-partitioned (equal ones fall to one node by an aggregate first), so no node's
children ever gather in a task; where a partition begins within a branch, what is open there comes from one
small summary per partition.

Every node carries its text with marks and its token ids, its depth-first offset, position ids (its ancestors' length
on) and the intervals of its ancestors, which with its own causal part are all that its tokens attend to. Ancestors
that stand next to each other are one interval, so that a chain of turns has one and not one per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: A turn is OPEN + role + BREAK + escaped text + CLOSE. "\\" begins an escape in texts and roles.
OPEN, BREAK, CLOSE = "<turn ", ">", "</turn>\n"
#: Roles whose texts count for the loss.
LOSS_ROLES = ["assistant"]


def escape(text: Column) -> Column:
    """Reversibly keeps marks out of a text: the backslash doubles, "<" and ">" become "\\l" and "\\g"."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The inverse: the pieces between doubled backslashes hold the other escapes only."""
    back = lambda s: F.replace(F.replace(s, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), back), "\\")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(BREAK), escape(text), F.lit(CLOSE))


def prefix_tree(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``leaves`` of the tree of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    nodes: ``node`` (its path's hash), ``parent``, ``depth``, ``role``, ``formatted``, ``ids``, ``loss``, ``n_tokens``,
    ``dfs_start`` (tokens emitted before it), ``position_start`` (tokens of its ancestors: its tokens have positions
    from there on) and ``attends`` (array of [start, end) of its ancestors in depth-first offsets, adjacent ones merged).
    leaves: ``conv_id``, ``node`` of its last turn and ``nodes`` of all. Tokens are the ids of ``tokenizer`` (a
    byte-level BPE file); without one tokens are code points and ``ids`` is null.

    Turns are ordered by turn, then role, then the SHA-256 of role and text (ties, so that no text is carried along
    to sort them); repeated rows of a turn are turns of their own; null texts and roles are empty; a null turn number
    comes first; rows with a null ``conv_id`` form one conversation; an empty table gives no rows.
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = base.withColumn("h", F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"), 256), 1, 24)))
    # one row a conversation: its turns' hashes only, the texts stay behind
    convs = hashed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "h"))), lambda x: x["h"]).alias("path"))
    convs = scratch.written(convs, "conversations")
    texts = hashed.select("h", "role", "text").distinct()
    measured = texts.withColumn("formatted", formatted(F.col("role"), F.col("text"))).drop("text")
    if tokenizer is None:
        sized = measured.withColumn("ids", F.lit(None).cast("array<int>"))
    else:
        sized = measured.mapInArrow(_encoder(tokenizer), "h binary, role string, formatted string, ids array<int>")
    sized = scratch.written(sized.withColumn("n_tokens", F.coalesce(F.array_size("ids"), F.char_length("formatted")).cast("long")), "turns")
    # distinct paths with the sizes of their turns
    paths = convs.select("path").distinct()
    flat = paths.select(F.sha2(_flat(F.col("path")), 256).alias("leaf"), F.posexplode("path").alias("k", "h")).join(sized.select("h", "n_tokens"), "h")
    ready = flat.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("k", "h", "n_tokens"))).alias("steps"))
    ordered = ready.select(_flat(F.transform("steps", lambda s: s["h"])).alias("key"), F.transform("steps", lambda s: s["h"]).alias("hs"), F.transform("steps", lambda s: s["n_tokens"]).alias("ns"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = scratch.written(ordered.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "paths")
    nodes = _walk(ordered)
    roles = F.col("role").isin(LOSS_ROLES)
    nodes = nodes.join(sized.select("h", "role", "formatted", "ids"), "h").select("node", "parent", "depth", "role", "formatted", "ids", roles.alias("loss"), "n_tokens", "dfs_start", "position_start", "attends")
    leaves = convs.select("conv_id", "path").mapInArrow(_chained, "conv_id long, nodes array<string>")
    return nodes, leaves.select("conv_id", F.element_at("nodes", -1).alias("node"), "nodes")


def _flat(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda h: F.hex(h)), "")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the nodes along each path: each the hash of its parent's id and its turn's hash."""
    for batch in batches:
        chains = []
        for path in batch.column(1).to_pylist():
            ids: list[str] = []
            for h in path:
                ids.append(_node(ids[-1] if ids else "", h))
            chains.append(ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.list_(pa.string()))], names=["conv_id", "nodes"])


def _encoder(tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        bpe = encoder(tokenizer)
        for batch in batches:
            ids = [bpe.encode(x.encode(), []) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["h", "role", "formatted", "ids"])

    return encode


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _walk(ordered: DataFrame) -> DataFrame:
    """The new nodes of every path in depth-first order, with offsets that run through all partitions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        total, starts = 0, []
        for part, hs, ns in rows(batches):
            if first is None:
                first, starts = hs, []
                same = 0
            else:
                same = _common(last, hs)
            starts = starts[:same]
            for n in ns[same:]:
                starts.append(total)
                total += n
            last, sizes = hs, ns
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.list_(pa.binary())), pa.array([last], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([total], pa.int64())], names=["part", "first", "last", "sizes", "starts", "total"])

    spark = ordered.sparkSession
    by_part = ordered.select("part", "hs", "ns", "key")
    parts = max(1, ordered.select(F.max("part")).first()[0] or 0) + 1
    dealt = by_part.repartition(parts, "part").sortWithinPartitions("part", "key").drop("key")
    # a task may hold several parts: summaries are made part by part
    kind = "part int, first array<binary>, last array<binary>, sizes array<bigint>, starts array<bigint>, total bigint"

    def by_parts(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, part = [], None
            for batch in batches:
                ids = batch.column(0).to_numpy()
                edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)] if len(ids) else []
                for a, b in zip(edges, edges[1:], strict=False):
                    if ids[a] != part and held:
                        yield from f(iter(held))
                        held = []
                    part = ids[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield from f(iter(held))

        return run

    told = sorted(dealt.mapInArrow(by_parts(summarise), kind).collect(), key=lambda r: r["part"])  # one row a partition
    entry: dict[int, tuple[list, list, list, int]] = {}
    hs: list = []
    ns: list = []
    starts: list = []
    offset = 0
    for r in told:
        entry[r["part"]] = (hs, ns, starts, offset)
        same = _common(hs, r["first"])
        # what the partition's first path shares with the open branch isn't emitted again
        shared_first = sum(ns[:same])
        new = [s if k < _common(hs, r["last"]) else offset + r["starts"][k] - shared_first for k, s in enumerate((starts + [0] * len(r["last"]))[: len(r["last"])])]
        offset += r["total"] - shared_first
        hs, ns, starts = r["last"], r["sizes"], new
    carried = spark.sparkContext.broadcast(entry)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        last = None
        for part, path, sizes in rows(batches):
            if last is None:
                last, last_sizes, begun, at = carried.value[part]
                ids: list[str] = []
                spans: list[list[tuple[int, int]]] = [[]]  # what each depth's children attend to
                position = [0]
                for h, n, start in zip(last, last_sizes, begun, strict=True):
                    ids.append(_node(ids[-1] if ids else "", h))
                    spans.append(_with(spans[-1], start, n))
                    position.append(position[-1] + n)
            same = _common(last, path)
            del ids[same:], spans[same + 1 :], position[same + 1 :]
            for k in range(same, len(path)):
                parent = ids[-1] if ids else None
                ids.append(_node(parent or "", path[k]))
                attends = [{"start": a, "end": b} for a, b in spans[k]]
                for c, v in zip(out, (path[k], ids[-1], parent, k, sizes[k], at, position[k], attends), strict=True):
                    c.append(v)
                spans.append(_with(spans[k], at, sizes[k]))
                position.append(position[k] + sizes[k])
                at += sizes[k]
            last = path
            if len(out[0]) >= 4096:
                yield _batch(out)
                out = [[] for _ in range(8)]
        yield _batch(out)

    return dealt.mapInArrow(by_parts(emit), "h binary, node string, parent string, depth int, n_tokens bigint, dfs_start bigint, position_start bigint, attends array<struct<start:bigint,end:bigint>>")


def _with(spans: list[tuple[int, int]], start: int, n: int) -> list[tuple[int, int]]:
    """``spans`` and [start, start + n), which joins the last one where it ends there."""
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], start + n)]
    return [*spans, (start, start + n)]


def _node(parent: str, h: bytes) -> str:
    return hashlib.sha256((parent + h.hex().upper()).encode()).hexdigest()[:32]


def _batch(out: list[list]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), span]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "node", "parent", "depth", "n_tokens", "dfs_start", "position_start", "attends"])


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The conversations that a tree's output holds: ``conv_id`` and ``turns``, an array of (k, role, text, loss,
    formatted_chars) by turn, parsed from the formatted texts of the nodes along each conversation's branch."""
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    role, text = F.substring_index("inner", BREAK, 1), F.expr(f"substring(inner, instr(inner, '{BREAK}') + {len(BREAK)})")
    parsed = nodes.withColumn("inner", inner).select("node", unescape(role).alias("role"), unescape(text).alias("text"), "loss", F.char_length("formatted").cast("long").alias("formatted_chars"))
    steps = leaves.select("conv_id", F.posexplode("nodes").alias("k", "node"))
    joined = steps.join(parsed, "node")
    return joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "loss", "formatted_chars"))).alias("turns"))
