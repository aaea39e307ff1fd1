"""WARC index, importance resampling and filter audit against plain Python."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.llm import audit, importance, warc
from meshframe.llm.text import blocks

SMALL = "/root/testdata/sf0.001"


def archive(spark, tmp_path, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, digest string")
    path = f"file://{tmp_path}/{hashlib.md5(repr(rows).encode()).hexdigest()}{len(how)}"
    warc.write_archives(pages, path, **how)
    return pages, path, warc.build_index(spark, path)


def expected(rows, least=0):
    last = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            last[data] = max(page, last.get(data, page))
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        to = last.get(data)
        to = to if page is not None and to is not None and page < to else None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a.example.com/x", "<p>é\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n</p>", "f", "d"),
    (2, "https://A.example.com/x", "<p>same</p>", "f", "d"),
    (3, "http://user@b.example.org:8080/y?q=1#top", "<p>same</p>", "f", "d"),
    (4, None, "<p>same</p>", "f", None),
    (5, "odd url\r\nX: y", None, None, "d"),
    (6, "", "", "f", "d"),
    (None, "http://a.example.com/x", "<p>same</p>", "f", "d"),
    (None, "http://c.example.com/", "only here", "f", "d"),
    (7, "http://a.example.com/x", "long " * 300_000, "f", "d"),
    (7, "http://a.example.com/x", "long " * 300_000, "f", "d"),
    (7, "http://a.example.com/x", "another text of page 7", "f", "d"),
]


@pytest.mark.parametrize("least", [0, 1, 12])
def test_warc_round_trip(spark, tmp_path, least):
    pages, path, index = archive(spark, tmp_path, PAGES, least=least)
    got = warc.read_records(warc.lookup(index, pages), path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES, least)
    texts = Counter((html or "").encode() for _, _, html, *_ in PAGES)
    assert all(bytes(r.payload) in texts for r in got if r.record_type == "response") and all(r.payload is None for r in got if r.record_type == "revisit")
    # every file is a sequence of records
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").collect():
        at = 0
        while at < len(r.content):
            at = warc.unpack(memoryview(r.content), at)[1]
        assert at == len(r.content)
        assert gzip.decompress(r.content).startswith(b"WARC/1.0\r\nWARC-Type: ") or not r.content


def test_warc_lookup_finds_all_captures_and_no_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, f"http{rng.choice(['', 's'])}://h{rng.randrange(9)}.example.com/{rng.randrange(20)}", f"page {i % 150}", None, None) for i in range(400)]
    rows += [(1000 + i, "http://hot.example.com/", f"hot {i}", None, None) for i in range(60)]
    pages, path, index = archive(spark, tmp_path, rows)
    assert index.agg(F.sum("n")).first()[0] == len(rows) and index.count() >= len(rows) // 7
    asked = ["http://h1.example.com/3", "https://h2.example.com/19", "http://hot.example.com/", "http://nowhere.example.com/"]
    found = warc.lookup(index, spark.createDataFrame([(u,) for u in [*asked, asked[0]]], "url string"))
    got = warc.read_records(found, path)
    assert Counter((r.page_id, r.url) for r in got.collect()) == Counter((p, u) for p, u, *_ in rows if u in asked)
    monkeypatch.setattr(warc, "arrow_reads", lambda *_: False)  # a store that only Spark reaches
    again = warc.read_records(found, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_warc_empty_and_broken(spark, tmp_path):
    pages, path, index = archive(spark, tmp_path, [])
    assert warc.read_records(warc.lookup(index, pages), path).count() == 0
    for record in (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"HTTP/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(warc.Broken):
            warc.parse(record)
    with pytest.raises(warc.Broken):
        warc.unpack(memoryview(warc.member(b"x" * 500)[:20]), 0)


def test_members_end_with_a_zero():
    """A record of 16 MB or more has an empty member behind it; several stand one after another."""
    records = [b"short\r\n\r\n", b"x" * (1 << 24) + b"\r\n\r\n", b"y" * 100_000 + b"\r\n\r\n", b"\r\n\r\n"]
    data = b"".join(warc.member(r) + b"\0" for r in records)
    assert gzip.decompress(data) == b"".join(records)
    at, back = 0, []
    while at < len(data):
        record, at = warc.unpack(memoryview(data), at)
        back.append(record)
    assert back == records and at == len(data)


def test_url_keys(spark):
    rows = [("http://M.th.example.net/en/25#top", "net,example,th,m)/en/25#top"), ("https://u:p@x.org:81/?a", "org,x:81)/?a"), ("about:blank", "about:blank"), ("", "")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r.k == r.want for r in df.select("want", warc.url_key(F.col("url")).alias("k")).collect())


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, max_run=2):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]


def sampled(docs, target, percent=25, max_run=2, buckets=10_000, seed=7, least_words=20):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, max_run)[1])

    s, t = count(x for _, x in docs), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n, fs = runs(text, max_run)
        b = [zlib.crc32(f.encode()) % buckets for f in fs]
        gain = [math.floor(1000 * math.log(((t[x] + 1) * float(total_s + buckets)) / ((s[x] + 1) * float(total_t + buckets)))) for x in b]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= least_words and r[3] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_against_plain_python(spark):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    pairs, aims = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    for how in ({}, {"percent": 60, "max_run": 3, "buckets": 101, "seed": 1, "least_words": 5}):
        got = importance.resample(docs, target, **how)
        assert sorted(map(tuple, got.collect()), key=str) == sampled(pairs, aims, **how)


def test_resampling_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "É é Ä\x00b\tc" * 8), (5, "w" * 100_000 + " x" * 50), (6, "a b c d e f g h i j k l m n o p q r s t u v"), (None, "a b " * 30)]
    rows += [(7, "same words " * 20), (7, "same words " * 20), (8, "word " * 200_000), (9, "x" * 70 + " " + "y" * 70 + " " + "x" * 70 + " a b" * 12)]
    docs = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, text string, rank int, score double")
    aims = ["A b c", None, "same words"]
    target = spark.createDataFrame([(t, 1) for t in aims], "text string, weight int")
    assert sorted(map(tuple, importance.resample(docs, target, percent=50).collect()), key=str) == sampled(rows, aims, percent=50)
    assert {c for c, _ in importance.resample(docs, target).dtypes} == {"doc_id", "n_features", "weight", "score", "rank"}
    drawn = importance.draw(docs, target, percent=100)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {4, 5, 6, 7, 8, 9} and drawn.count() == 7
    none = docs.limit(0)
    assert importance.resample(none, target).count() == 0
    assert sorted(map(tuple, importance.resample(docs, target.limit(0)).collect()), key=str) == sampled(rows, [])


def test_checksums_of_matrices():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m = rng.integers(0, 256, (50, 9), dtype=np.uint8)
    assert [zlib.crc32(r.tobytes()) for r in m] == importance.crc_rows(m).tolist()
    texts = ["ab cd", "", "cd", "ab cd é" + "z" * 80, None, "z" * 80 + " ab  cd"]
    for block in blocks(pa.array(texts, pa.string())):
        n, first, levels = importance.feature_buckets(block, 2, 1 << 32)
        own = [i for i in range(len(texts)) for _ in range(n[i])]
        for k, (hashed, which, places) in enumerate(levels, 1):
            got = Counter((own[p], int(hashed[w])) for p, w in zip(places, which, strict=True))
            assert got == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in runs(t)[1] if f.count(" ") == k - 1)
            assert len(hashed) == len({f for t in texts for f in runs(t)[1] if f.count(" ") == k - 1})


def audited(docs, labels):
    words = re.compile("[^\x20\x09-\x0d]+")
    marks = {}
    for i, q, t in labels:
        a = marks.setdefault(i, [0, 0])
        a[0], a[1] = max(a[0], int(q == 1)), max(a[1], int(t == 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = {}
    flags = []
    for i, text, lang in docs:
        t = text or ""
        w = words.findall(t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        flags.append((lang or "", f, marks.get(i, (0, 0)) if i is not None else (0, 0)))
    shapley = Counter()
    for order in permutations(range(5)):
        name = "".join("ABCDE"[k] for k in order)
        for part in {p for p, *_ in flags}:
            left = [(f, m) for p, f, m in flags if p == part]
            every = left
            for step, k in enumerate(order, 1):
                gone = [(f, m) for f, m in left if f[k]]
                left = [(f, m) for f, m in left if not f[k]]
                fails = sum(f[k] for f, _ in every)
                out[part, name, step] = [len(left), len(gone), fails - len(gone), sum(f[k] and sum(f) == 1 for f, _ in every), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone)]
                shapley[part, k] += len(gone)
    return sorted((*key, *v, shapley[key[0], "ABCDE".index(key[1][key[2] - 1])]) for key, v in out.items())


def test_audit_against_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    want = audited([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(map(tuple, audit.audit(docs, labels).collect())) == want


def test_audit_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "", "en"), (None, "", "en"), (None, None, None), (4, "A" * 50, "en"), (4, "A" * 50, "de"), (4, "A" * 50, "de"), (5, "A" * 50, "en"), (6, "w " * 100_000, "en"), (7, "w%d " * 3, "en"), (8, " ".join(f"w{i}" for i in range(250)), "xx")]
    marks = [(4, 1, None), (4, 0, 1), (5, None, None), (None, 1, 1), (8, 1, 0), (99, 1, 1), (3, 7, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, part int, n string")
    labels = spark.createDataFrame([(*r, "y") for r in marks], "doc_id long, quality int, toxic int, lang string")
    assert sorted(map(tuple, audit.audit(docs, labels).collect())) == audited(rows, marks)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert sorted(map(tuple, audit.audit(docs, labels.limit(0)).collect())) == audited(rows, [])
