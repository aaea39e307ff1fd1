"""Text operators against brute force, on cases of their own and on the smallest tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshframe.llm import queries as Q
from meshframe.llm.jaccard import jaccard_join, linked, one_of_each
from meshframe.llm.packing import pack, plan, size_class
from meshframe.llm.substring import remove_repeats

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cid string, rk string"


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names, copies and shared passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéü'") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, "Two WORDS"), (7, "a b c"), (8, "a b c"), (8, "a b c"), (None, "a b c"), (None, None)]
    for i in range(10, 40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    for i in range(40, 60):
        rows.append((i, " ".join(word() for _ in range(r.randint(0, 90))) + " " + passage + "  " + " ".join(word() for _ in range(r.randint(0, 90)))))
    rows.append((60, " ".join(word() for _ in range(12000))))
    rows.append((61, "x" * 30000))
    rows.append((62, "<|endoftext|> a<|endo ftext|> b c Ⅷ ΣΑΣ İ é é don't I'LL   \n\n  9999 ½ 你好 🙂" * 3))
    rows.append((63, rows[-1][1]))
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "c", "k") for i, t in rows], SCHEMA).repartition(3)


def tables(spark, docs):
    return [docs, spark.read.parquet(f"{SMALL}/documents.parquet")]


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in split(t)]
        sets[i] = {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({b" ".join(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("which", [0, 1])
def test_jaccard(spark, docs, which):
    table = tables(spark, docs)[which]
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    for k, num in ((3, 90), (5, 80)):
        want = brute_jaccard([r for r in rows if r[0] is not None], k, num, 100)
        got = jaccard_join(table, k, num, 100).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_empty(spark, docs):
    assert jaccard_join(docs.limit(0)).count() == 0


def test_one_of_each(spark, docs):
    kept = [r.doc_id for r in one_of_each(docs).select("doc_id").collect()]
    want = brute_jaccard([tuple(r) for r in docs.where("doc_id is not null").select("doc_id", "text").collect()], 5, 80, 100)
    assert sorted(x for x in set(kept) if x is not None) == sorted(i for i, (_, c) in want.items() if c == i)


def test_linked_forest():
    r = np.random.default_rng(1)
    for trial in range(30):
        core = r.integers(0, 2**40, 60)
        sets = []
        for _ in range(r.integers(2, 330)):
            s = core.copy()
            n = r.integers(0, 9)
            s[r.integers(0, 60, n)] = r.integers(0, 2**40, n)
            sets.append(np.unique(s[: r.integers(40, 61)]).astype(np.uint64))
        num = 90 if trial % 2 else 80
        up = list(range(len(sets)))
        want, got = list(up), list(up)

        def root(f, x):
            while f[x] != x:
                x = f[x]
            return x

        py = [set(s.tolist()) for s in sets]
        for a in range(len(py)):
            for b in range(a):
                if 100 * len(py[a] & py[b]) >= num * len(py[a] | py[b]):
                    x, y = root(want, a), root(want, b)
                    want[max(x, y)] = min(x, y)
        for a, b in linked(sets, num, 100):
            assert 100 * len(py[a] & py[b]) >= num * len(py[a] | py[b])
            x, y = root(got, a), root(got, b)
            got[max(x, y)] = min(x, y)
        assert [root(got, x) for x in up] == [root(want, x) for x in up]


@pytest.mark.parametrize("which", [0, 1, "repeats"])
def test_substring(spark, docs, which):
    if which == "repeats":  # words over and over, short periods, shared borders within them
        r = random.Random(8)
        passage = [f"w{r.randint(0, 400)}" for _ in range(90)]
        make = [lambda: ["the"] * r.randint(1, 130), lambda: ["a", "b"] * r.randint(1, 60), lambda: ["a", "b", "c"] * r.randint(1, 40), lambda: passage[r.randint(0, 30) : r.randint(60, 90)], lambda: [f"u{r.randint(0, 9999)}" for _ in range(r.randint(1, 60))], lambda: r.choices(["x", "y"], k=r.randint(1, 70))]
        made = [(i, " ".join(w for _ in range(r.randint(1, 5)) for w in r.choice(make)())) for i in range(150)]
        table = spark.createDataFrame([(i, t, "en", "s", 0, 1, "c", "k") for i, t in made], SCHEMA).repartition(3)
    else:
        table = tables(spark, docs)[which]
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    low = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - 49):
            if i is not None:
                key = b" ".join(w[j : j + 50])
                low[key] = min(low.get(key, i), i)
    want = defaultdict(list)
    for i, t in rows:
        w = split(t)
        gone = set()
        for j in range(len(w) - 49):
            if i is not None and low[b" ".join(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i].append((len(w), len(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    out = remove_repeats(table)
    assert out.columns[:3] == table.columns[:3]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256, " ".join(x.decode() for x in split(r.text))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(v[1] for x in want.values() for v in x)
    assert remove_repeats(table.limit(0)).count() == 0


@pytest.mark.parametrize("which", [0, 1])
def test_bpe(spark, docs, which):
    from meshframe.llm.bpe import decode, encode

    table = tables(spark, docs)[which]
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    want = sorted((i is None, i or 0, lib.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in decode(encode(table, path), path).collect())
    assert got == want
    assert encode(table.limit(0), path).count() == 0


def test_bpe_joins():
    from meshframe.llm.bpe import encoder

    bpe = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["a", "'", "r", "e", " ", "  ", "\n", "1", "!", "é", "the", "'ll", " "]) for _ in range(r.randint(0, 40)))
        parts, at = [], 0
        while at < len(text):
            n = r.randint(1, 9)
            parts.append(text[at : at + n].encode())
            at += n
        assert bpe.join(parts).tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 5_000_000, " " * 2_000_000 + "end", "ab " * 300_000 + "<|endoftext|>", "word\x1c" * 5000 + "\n" * 9000])
def test_bpe_long(text):
    """One very long pre-token, or very many, takes time in proportion and no more stack."""
    import numpy as np
    from meshframe.llm.bpe import cuts, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    data = text.encode()
    ids = encoder(path).encode(data, cuts(np.frombuffer(data, np.uint8)).tolist())
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", [0, 1])
def test_packing(spark, docs, which):
    table = tables(spark, docs)[which]
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for i, t in table.select("doc_id", "text").collect():
        ids[i].append([*lib.encode(t or "", add_special_tokens=False).ids, 2])
    rows = pack(table, path).collect()
    seq = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert r.doc_tokens in {len(x) for x in ids[r.doc_id]}
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r.length)
    assert {k: sum(v) for k, v in pieces.items()} == {k: sum(map(len, v)) for k, v in ids.items()}
    for v in seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(sum, pieces.values()))
    assert len(seq) <= -(-total // 4096) * 1.02 + 1
    assert pack(table.limit(0), path).count() == 0


def test_plan_is_exact_and_tight():
    r = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, r.lognormal(6, 1.2, 200_000).astype(int)))
    hist = dict(zip(*map(np.ndarray.tolist, np.unique(size_class(lengths, 4096), return_counts=True)), strict=True))
    patterns = plan(hist, 4096)
    used = defaultdict(int)
    for p, n in patterns:
        assert sum(s * a for s, a in p.items()) <= 4096
        for s, a in p.items():
            used[s] += a * n
    assert dict(used) == hist
    assert sum(n for _, n in patterns) * 4096 < 1.02 * lengths.sum()


def test_rules_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    for name, sql in Q.oracle_sql().items():
        frame = Q.queries()[name](spark, SMALL).toPandas()
        other = con.sql(sql).df()
        assert list(frame.columns) == list(other.columns), name
        key = list(frame.columns)
        a, b = (x.astype(str).sort_values(key).reset_index(drop=True) for x in (frame, other))
        assert a.equals(b), name


def test_rules_edges(spark, docs):
    from meshframe.llm.rules import apply_rules

    out = {r.doc_id: r for r in apply_rules(docs.where("doc_id is not null")).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and not out[1].kept
    assert out[61].n_words == 1 and out[61].word_chars == 30000
    w = split(docs.where("doc_id = 60").first().text)
    assert out[60].n_words == len(w) and out[60].n_repeat_words == 0
    many = spark.createDataFrame([(1, "a b c d e f g h " * 40), (2, "x a b c d e f g h a b c d e f g h y z")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in apply_rules(many).collect()}
    assert got == {1: 320, 2: 16}


def test_quality(spark, docs):
    from meshframe.llm.quality import fit

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.op1_quality_classifier(spark, "/root/testdata/sf0.01")
    assert out.count() == table.count()
    assert out.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").count() == 0
    held = out.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()
    model = fit(table, labels)
    assert model.score(docs).count() == docs.count()
    assert fit(docs.limit(0), labels).score(docs).where("predicted = 1").count() == docs.count()
