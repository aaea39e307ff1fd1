"""WARC archives of pages and a two-level index of their captures.

Archives are WARC files of one gzip member a record, as Spark's text writer makes them: one record a row, so that a lost
executor costs a task and nothing half-written is seen. The writer ends each row with a separator, here a zero byte, which
is the last byte of the member: that of its length, zero for all members under 16 MB. Payloads that occur more than once are kept once; the others are revisit records whose HTTP
header tells the payload's length.

The index sorts captures by URL key, host reversed, into compressed blocks of many captures. The directory has the first
and last key of each block only; it never has more than about ``DIRECTORY`` rows, blocks grow instead. A lookup
binary-searches the directory in memory, opens the blocks that it names, and reads the records of the captures found by
byte ranges of their files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: Bytes of payloads in an archive, about, before compression, and bytes of one range read.
ARCHIVE, RANGE = 32 << 20, 4 << 20
#: Captures of a block at least, and rows of the directory at most (one more for each partition that sorts).
BLOCK, DIRECTORY = 1000, 100_000
END = "\r\n\r\n"
ENTRY = "key string, url string, record_id string, record_type string, digest string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: Column) -> Column:
    """The bare base32 SHA-1 of a payload: each five hexadecimal digits are four letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    h = F.sha1(payload)

    def four(i: Column) -> Column:
        v = F.conv(F.substr(h, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substr(alphabet, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def header_safe(url: Column) -> Column:
    """A URL as headers and the index have it: null is empty; line breaks and tabs are percent-encoded."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    for sign, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        u = F.replace(u, F.lit(sign), F.lit(code))
    return u


def url_key(url: Column) -> Column:
    """The key by which captures are sorted: host labels reversed, then port, then the rest; scheme and a user are dropped
    and the host is in small letters. What has no host is its own key."""
    part = lambda k: F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?(.*)$", k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), "\\.")), ",")
    return F.when(part(1) != "", F.concat(host, part(2), F.lit(")"), part(3))).otherwise(url)


def with_revisits(pages: DataFrame, least: int = 0, parts: int = 1) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` for every row of ``pages`` (``page_id``, ``url``, ``html``), in ``parts``
    partitions. Payloads are shuffled once; rows that repeat both a page_id and a payload come to one partition.

    Of rows with equal payloads of at least ``least`` bytes all but those of the largest page_id refer to it. Null html is an
    empty payload. Rows without page_id, and rows that share the largest, refer to nothing.

    Only ids and digests are shuffled for the decision. Digests of over a thousandth of all rows, of which there are fewer
    than a thousand, meet their copies by broadcast; no task gets them all."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), header_safe(F.col("url")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload")))
    narrow = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = written(narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("k")).where("k > 1 and last is not null"), "digests")
    n = pages.count()
    often = F.col("k") * 1000 > n
    heavy, light = groups.where(often).select("digest", "last"), groups.where(~often).select("digest", "last")
    some = narrow.join(F.broadcast(groups.where(often).select("digest")), "digest", "left_anti").join(light, "digest")
    hot = narrow.join(F.broadcast(heavy), "digest")
    copies = some.unionByName(hot).where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    keys = ["page_id", "digest"]
    return rows.repartition(parts, *keys).join(copies.repartition(parts, *keys), keys, "left")


def _headers(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(c for name, value in pairs for c in (F.lit(f"{name}: "), value, F.lit("\r\n"))))


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is zero; a record of 16 MB or more has an empty member behind its own."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = pack.compress(record) + pack.flush()
    if data[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += pack.flush()
    return data[:-1]


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive: int = ARCHIVE) -> None:
    """Write one WARC record per row of ``pages`` to ``path``/archives; see ``with_revisits`` for what becomes a revisit.

    Records name their page by its id, ``<urn:page:7>``. Files hold about ``archive`` bytes of payload, or less: there are
    as many as shuffle partitions at least (with fewer, Spark would shuffle payloads again for the join with revisits)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_buffer()) for r in batch.column(0)], pa.binary())], names=["value"])

    stored = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = with_revisits(pages, least, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // archive)))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    rows = rows.withColumn("block", block)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _headers(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", urn(F.col("page_id"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.when(again, _headers(("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), ("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
    )
    records = rows.select(F.concat(head, F.lit("\r\n"), "block", F.lit(END)).cast("binary").alias("value")).mapInArrow(packed, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(f"{path}/archives")


class Broken(ValueError):
    """An archive that isn't what its headers say."""


def unpack(data: memoryview, at: int) -> tuple[bytes, int]:
    """The record whose member begins at ``at``, and where the next one begins."""
    out, last = [], 1
    while last:  # a member that doesn't end with zero has an empty one behind it
        pack = zlib.decompressobj(31)
        while not pack.eof:
            piece = data[at : at + 65_536]
            if not piece:
                raise Broken("an archive ends within a record")
            out.append(pack.decompress(piece))
            at += len(piece) - len(pack.unused_data)
        last = data[at - 1]
    return b"".join(out), at


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if first != "WARC/1.0" or rest[int(headers["Content-Length"]) :] != END.encode():
        raise Broken("a record doesn't begin or end where it should")
    return headers, rest[: -len(END)]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``key, url, record_id, record_type, digest, file, offset, length`` of every record of the archives, a file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "record_id", "record_type", "digest", "file", "offset", "length"]
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py().rsplit("/", 1)[1]
                data = memoryview(batch.column(1)[i].as_buffer())
                rows: list[list] = [[] for _ in names]
                at = 0
                while at < len(data):
                    record, to = unpack(data, at)
                    h, _ = parse(record)
                    row = (h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), file, at, to - at)
                    for values, x in zip(rows, row, strict=True):
                        values.append(x)
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in rows[:5]] + [pa.array(v, pa.int64()) for v in rows[5:]], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").select("path", "content")
    found = files.mapInArrow(run, ENTRY.removeprefix("key string, "))
    return found.select(url_key(F.col("url")).alias("key"), "*")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the index of ``path``/archives, written to ``path``/index: ``block, first_key, last_key, n, data``, in
    the order of the keys. A key of many captures runs through several blocks."""
    found = written(captures(spark, path), "captures")
    total = found.count()
    size = max(BLOCK, -(-total // DIRECTORY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, r)) for r in rows)
            columns = [pa.array([number], pa.int64()), *(pa.array([rows[k][0]], pa.string()) for k in (0, -1)), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(text.encode())], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "first_key", "last_key", "n", "data"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= size:
                yield block(held[:size])
                held, number = held[size:], number + 1
        if held:
            yield block(held)

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // size)))
    order = ["key", "file", "offset"]
    blocks = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "block long, first_key string, last_key string, n long, data binary")
    blocks.write.parquet(f"{path}/index")
    return spark.read.schema(blocks.schema).parquet(f"{path}/index")


def lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Every capture (``ENTRY``) of the URLs in ``asked`` (``url``; null asks for captures without one), each once. A URL that
    has none gives no row; URLs that share a key are told apart."""
    directory = sorted((r.first_key.encode(), r.last_key.encode(), r.block) for r in index.select("block", "first_key", "last_key").collect())
    firsts, lasts, numbers = (list(c) for c in zip(*directory, strict=True)) if directory else ([], [], [])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, keys, blocks = [], [], []
            for url, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = key.encode()
                for i in range(bisect_left(lasts, k), bisect_right(firsts, k)):
                    urls.append(url)
                    keys.append(key)
                    blocks.append(numbers[i])
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(keys, pa.string()), pa.array(blocks, pa.int64())], names=["url", "key", "block"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*(line.split("\t") for line in zlib.decompress(data).decode().split("\n")), strict=True))
                arrays = [pa.array(c, pa.string()) for c in columns[:6]] + [pa.array(list(map(int, c)), pa.int64()) for c in columns[6:]]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(arrays[0]), pa.int64()), *arrays], names=["block", *(c.split()[0] for c in ENTRY.split(", "))])

    wanted = asked.select(header_safe(F.col("url")).alias("url")).distinct().select("url", url_key(F.col("url")).alias("key"))
    hits = wanted.mapInArrow(search, "url string, key string, block long")
    opened_blocks = index.select("block", "data").join(hits.select("block").distinct(), "block", "left_semi").mapInArrow(opened, f"block long, {ENTRY}")
    # a key of many captures is met in each of its blocks apart
    return opened_blocks.join(hits, ["block", "key", "url"], "left_semi").select(*(c.split()[0] for c in ENTRY.split(", ")))


def _slices(rows: list[tuple[str, int, int]], read: Callable[[str, int, int], bytes]) -> Iterator[memoryview]:
    """The bytes of ranges in the order of file and offset; neighbours of up to ``RANGE`` bytes are read at once."""
    i = 0
    while i < len(rows):
        file, begin, n = rows[i]
        j, stop = i + 1, begin + n
        while j < len(rows) and rows[j][0] == file and rows[j][1] == stop and stop + rows[j][2] - begin <= RANGE:
            stop += rows[j][2]
            j += 1
        data = memoryview(read(file, begin, stop - begin))
        for _, at, size in rows[i:j]:
            yield data[at - begin : at - begin + size]
        i = j


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _records(slices: Iterator[memoryview], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Rows of RECORD, in batches of bounded size; a payload must have the digest and the length that its record names."""
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for data in slices:
        h, block = parse(unpack(data, 0)[0])
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
        told = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
            raise Broken(f"payload of {h['WARC-Record-ID']} differs from its digest or length")
        keep = payload if with_payload and h["WARC-Type"] == "response" else None
        rows.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), length, told, keep))
        held += 1 + len(keep or b"")
        if len(rows) >= 10_000 or held >= RANGE:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def arrow_reads(spark: SparkSession, path: str) -> bool:
    """Whether a task's Arrow file systems reach ``path``, so that it can read ranges there."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                fs, own = _opened(path)
                seen = fs.get_file_info(f"{own}/archives").type.name == "Directory"
            except (pa.ArrowException, OSError, ImportError):
                seen = False
            yield pa.RecordBatch.from_arrays([pa.array([seen])], names=["seen"])

    return spark.range(1, numPartitions=1).mapInArrow(probe, "seen boolean").first()[0]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_records(entries: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records (``RECORD``) at ``entries`` (``file, offset, length``), read by ranges. A revisit has no payload of its own;
    ``payload_bytes`` and ``payload_digest`` are those of the full payload. Without ``with_payload`` payloads are read and
    checked, but not returned.

    Tasks read the ranges themselves where their Arrow file systems reach the folder; in other stores Spark reads
    the files that hold a capture, and the ranges are cut from these."""
    spark = entries.sparkSession
    places = entries.select("file", "offset", "length")
    if arrow_reads(spark, path):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, own = _opened(path)
            held: dict[str, pa.NativeFile] = {}

            def read(file: str, begin: int, n: int) -> bytes:
                if file not in held:
                    for f in held.values():
                        f.close()
                    held.clear()
                    held[file] = fs.open_input_file(f"{own}/archives/{file}")
                return held[file].read_at(n, begin)

            for batch in batches:
                yield from _records(_slices(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), read), with_payload)

        order = ["file", "offset"]
        return places.repartition("file", F.floor(F.col("offset") / RANGE)).sortWithinPartitions(*order).mapInArrow(run, RECORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(0)[i].as_buffer())
                rows = sorted((("", r["offset"], r["length"]) for r in batch.column(1)[i].as_py()), key=lambda r: r[1])
                yield from _records(_slices(rows, lambda _, begin, n, data=data: data[begin : begin + n]), with_payload)

    by_file = places.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # an archive's records
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(by_file, "file").select("content", "ranges").mapInArrow(cut, RECORD)
