"""The quality classifier and the pipeline against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshframe.llm import queries as Q
from meshframe.llm import quality
from meshframe.llm.pii import replace_entities
from meshframe.llm.rules import STOP_WORDS, apply_rules

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile("[ \t-\r]+")


def features(text):
    t = text or ""
    words = [w for w in SPACE.split(t) if w]
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    often = Counter(windows)
    repeated = len({i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(8)})
    ratio = lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(regex.findall(pattern, t))
    stop = set(STOP_WORDS)
    length = len(SPACE.sub("", t))
    return [
        math.log1p(n),
        ratio(length, n),
        math.log1p(10 * ratio(count(r"[#*$%&|<>]"), n)),
        math.log1p(10 * ratio(count("[!?]"), n)),
        ratio(sum(w.translate(str.maketrans("", "", ".,;:!?*#$%&|")).lower() in stop for w in words), n),
        ratio(len(lines) - len(set(lines)), len(lines)),
        math.log1p(ratio(n, len(lines))),
        ratio(count(r"\p{Lu}"), length),
        ratio(count("[0-9]"), length),
        ratio(count("[.,;:]"), n),
        ratio(repeated, n),
        ratio(len(set(words)), n),
        ratio(sum(bool(regex.search(r"[^\p{L}.,;:]", w)) for w in words), n),
        ratio(sum(len(w) > 12 for w in words), n),
    ]


def score(model, text):
    s = sum((f - m) / d * w for f, m, d, w in zip(features(text), model.center, model.scale, model.weights, strict=True))
    p = 1 / (1 + math.exp(-max(-700, min(700, model.slope * (s - model.threshold) + math.log(0.7 / 0.3)))))
    return max(p, 0.7) if s >= model.threshold else min(p, math.nextafter(0.7, 0))


def test_quality_against_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels.where(~Q.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.op1_quality_classifier(spark, SMALL).collect():
        want = score(model, texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    # the weights are where the logistic loss on the pairs' differences, with its ridge, is flat
    marks = {r.doc_id: r.quality for r in labels.collect()}
    x = {q: np.array([features(texts[i]) for i, v in marks.items() if v == q and i in texts and zlib.crc32(str(i).encode()) % 4 != 2]) for q in (0, 1)}
    z = {q: (v - np.array(model.center)) / np.array(model.scale) for q, v in x.items()}
    w = quality.bradley_terry(z[1], z[0])
    rng = np.random.default_rng(17)
    d = z[1][rng.integers(0, len(z[1]), quality.PAIRS)] - z[0][rng.integers(0, len(z[0]), quality.PAIRS)]
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.RIDGE * w).max() < 1e-6
    odd = spark.createDataFrame([(1, None, 0.5, 9, "a"), (1, None, 0.5, 9, "a"), (2, "", 0.1, 9, "b"), (3, "word " * 200_000, 0.1, 9, "c"), (None, "x", 0.0, 1, "d")], "doc_id long, text string, score double, predicted int, f string")
    out = model.score(odd).collect()
    assert len(out) == 5 and out[0] == out[1] and all(0 <= r.score <= 1 for r in out) and {r.f for r in out} == set("abcd")


def test_rules_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words here", "mine", 5)], "doc_id long, text string, __words string, n_words long")
    r = apply_rules(df).first()
    assert r["__words"] == "mine" and r["n_words"] == 3 and set(apply_rules(df).columns) >= set(df.columns)


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect() if score(model, r.text) >= 0.7}
    words = lambda t: [w for w in SPACE.split(t or "") if w]
    fold = lambda w: re.sub("[A-Z]", lambda m: m.group().lower(), w)
    sets = {}
    for i, t in texts.items():
        w = [fold(x) for x in words(t)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    kept = [i for i in ids if find(i) == i]
    low = {}
    for i in kept:
        w = words(texts[i])
        for j in range(len(w) - 49):
            low.setdefault(tuple(w[j : j + 50]), i)
    left = {}
    for i in kept:
        w = words(texts[i])
        gone = {d for j in range(len(w) - 49) if low[tuple(w[j : j + 50])] < i for d in range(j, j + 50)}
        if not gone:
            left[i] = texts[i]
        elif len(gone) < len(w):
            left[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    cleaned = replace_entities(spark.createDataFrame(sorted(left.items()), "doc_id long, text string"), Q.PII_SECRET)  # has a brute-force test of its own
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in cleaned.collect():
        own = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] = own
    rows, at, load = corpus_pipeline.run(spark, SMALL).collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        own = want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own)
        at[r.doc_id].append((r.start, r.length))
        load[r.sequence_id].append((r.offset, r.length))
    assert set(at) == set(want)
    for pieces, total in ((v, len(want[i])) for i, v in at.items()):
        assert [s for s, _ in sorted(pieces)] == list(np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1]) and sum(n for _, n in pieces) == total
    for pieces in load.values():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1]) and sum(n for _, n in pieces) <= 4096
