"""The queries ``opN_<name>``: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import STOP_WORDS

#: Keys the surrogates of the PII query and of the pipeline; a deployment passes its own.
PII_SECRET = "surrogate-key-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; labels are learned from the rows that aren't held out."""
    from .quality import fit

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels").where(~F.coalesce(held_out(), F.lit(False))))
    return model.score(docs.select("doc_id", "text")).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    rows = apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, top=20)


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    path = _vocabulary("byte_bpe_50k.json")
    rows = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_SECRET)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted in four batches; exact copies are deleted; a quarter's counts are revised to
    include the end id; two batches are committed again, which changes nothing. Returns the cube of totals."""
    from . import scratch
    from .rollup import TokenRollup, count_tokens

    docs = _table(spark, sf_dir, "documents")
    counts = scratch.written(count_tokens(docs, _vocabulary("word_bpe_49k.json"), "word_bpe_49k"), "counts")
    store = TokenRollup(spark, f"{scratch.shared_dir(spark)}/work/rollup-{uuid.uuid4().hex}")
    quarter = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    for q in range(4):
        store.insert(f"insert-{q}", counts.where(F.coalesce(quarter, F.lit(0)) == q))
    marks = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    first = marks.groupBy("h").agg(F.min("doc_id").alias("first"))
    store.delete("copies", marks.join(first, "h").where("doc_id > first"))
    standing = counts.where(quarter == 2).join(store.ledger().select("doc_id").distinct(), "doc_id", "left_semi")
    revised = standing.withColumn("n_tokens", F.col("n_tokens") + 1)
    store.revise("with-end-id", revised)
    store.insert("insert-1", counts.where(quarter == 1))
    store.revise("with-end-id", revised)
    return store.cube()


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations as read back from the prefix tree."""
    from .chat import prefix_tree, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    nodes, leaves = prefix_tree(turns.unionByName(own), _vocabulary("byte_bpe_50k.json"))
    back = read_back(nodes, leaves)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["formatted_chars"]).alias("formatted_chars"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard similarity of 0.9 or more."""
    from .jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, indexed, looked up by all their URLs and read back by ranges."""
    from . import scratch
    from .warc import build_index, lookup, read_records, write_archives

    pages = _table(spark, sf_dir, "pages")
    path = f"{scratch.shared_dir(spark)}/work/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    index = build_index(spark, path)
    records = read_records(lookup(index, pages.select("url")), path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the distribution of the benchmark's words and word pairs."""
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, max_run=2, buckets=10_000, seed=7, least_words=20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by language."""
    from .audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

_OP2 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
v AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
    len(list_filter(w, lambda x: list_contains([{_STOP}], lower(x)))) AS stops, len(l) AS lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS opens
  FROM d LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2 AND 14 AND n_symbols / n_words::DOUBLE <= 0.2
  AND marks / n_words::DOUBLE <= 0.5 AND stops / n_words::DOUBLE >= 0.02 AND n_dup_lines / lines::DOUBLE <= 0.4
  AND bullets / lines::DOUBLE <= 0.9 AND opens / lines::DOUBLE <= 0.5 AS kept
FROM b
"""

_OP8 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS win FROM g),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM v),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r WHERE lo < doc_id),
x AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
a AS (SELECT d.doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS j FROM d),
k AS (SELECT a.doc_id, string_agg(w[a.j], ' ' ORDER BY a.j) FILTER (a.j > 0 AND c.j IS NULL) AS kept FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN x USING (doc_id)
"""

_OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS s, max(page_id) OVER (PARTITION BY t) AS last FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || s[5 * i + 1 : 5 * i + 5])::BIGINT) AS q FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(q, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> k::BIGINT) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""

_OP12 = """
WITH RECURSIVE c(n, v, k) AS (
  SELECT n, n, 0 FROM range(0, 256) r(n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS tbl FROM c WHERE k = 8),
a AS (
  SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM a),
f AS (
  SELECT side, id, unnest(w) AS feature FROM w
  UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(feature))), lambda i: ('0x' || hex(encode(feature))[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda s, x: xor(s >> 8, tbl[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM n), crc),
k AS (SELECT side, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (feature) GROUP BY ALL),
t AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM k),
g AS (
  SELECT x.bucket, floor(1000 * ln(((coalesce(y.n, 0) + 1)::DOUBLE * (t.s + 10000)::DOUBLE) / ((x.n + 1)::DOUBLE * (t.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT * FROM k WHERE side = 0) x LEFT JOIN (SELECT * FROM k WHERE side = 1) y USING (bucket), t),
m AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
d AS (
  SELECT w.id AS doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features::DOUBLE), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m ON m.doc_id = w.id WHERE side = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS enough FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * enough // 100 THEN place END AS rank FROM r
"""

_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
b AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, f),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (
  SELECT c.*, filter_order, step, o[step] AS own,
    len(list_filter(o[1 : step - 1], lambda i: f[i])) = 0 AS reaches, f[o[step]] AS fails, len(list_filter(f, lambda v: v)) AS failed
  FROM c, s),
q AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (reaches AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reaches AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (NOT reaches AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (reaches AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (reaches AND fails), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own, step), step::INTEGER AS step, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM q
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; the tests hold the others against brute force."""
    return {"op2_quality_rules": _OP2, "op8_substring_dedup": _OP8, "op11_warc_index": _OP11, "op12_importance_resampling": _OP12, "op13_filter_audit": _OP13}
