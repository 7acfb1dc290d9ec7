"""The registered queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import align, bpe, cws, decontaminate, language, licenses, lines, merkle, simhash, suffix_tree, toxicity, urls, warc
from tideline.llm.common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL filter.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def part(mod: int) -> Column:
    """The remainder that deals documents out for training and testing."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.get("licenses", F.lit(0))
    return out.select("doc_id", F.size("licenses").alias("n_licenses"), best["license"].alias("license"), best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"), "licenses")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_bytes=1000).withColumnRenamed("key", "page_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(part(3) != 1))
    out = language.predict(docs, model)
    return out.select("doc_id", F.coalesce(part(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(part(5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(part(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = align.counted(written(aligned.withColumn("groups", digest), "aligned"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(table(spark, sf_dir, "documents"), part(10) != 0)
    return out.select("doc_id", F.coalesce(part(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = merkle.manifest(docs, claimed={"n_chars": F.try_add("n_chars", F.lit(1))}, where=part(7) == 0)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_document_fingerprints, op3_license_scans, op4_simhash_near_dedup, op5_warc, op6_line_dedup, op7_benchmark_decontamination, op8_language_id, op9_bpe, op10_toxicity, op11_tokenizer_alignment, op12_lm_scoring, op13_merkle_manifest)
}

#: CRC-32 of a key's decimal form, bit by bit: every byte is followed by seven empty ones.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295)"""

OP5_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT r, page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best,
             payload_bytes < 1000 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, r) = 1 AS own FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT own THEN best END AS refers_to
FROM w
"""

OP6_SQL = r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY r
"""

OP7_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10 + 1, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
pos AS (SELECT r, ws, unnest(ws) AS first_word, generate_subscripts(ws, 1) AS i FROM dw),
hit AS (SELECT r, i, len(w) AS n, item_id FROM pos JOIN win ON first_word = w[1] AND list_slice(ws, i, i + len(w) - 1) = w),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, lang, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS own, [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS other FROM documents),
h AS (SELECT r, doc_id, coalesce('=' || lang, '') AS tree,
  sha256(list_aggregate(list_transform(own, lambda s: coalesce(strlen(s) || ':' || s, '-')), 'string_agg', '')) AS leaf,
  sha256(list_aggregate(list_transform(other, lambda s: coalesce(strlen(s) || ':' || s, '-')), 'string_agg', '')) AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
low(tree, lvl, pos, n, d) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT a.tree, a.lvl + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.d || coalesce(b.d, '')) FROM low a LEFT JOIN low b ON b.tree = a.tree AND b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
sub AS (SELECT tree, lvl AS depth, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, n, d) AS (
  SELECT 0, pos, n, d FROM sub
  UNION ALL
  SELECT a.lvl + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.d || coalesce(b.d, '')) FROM high a LEFT JOIN high b ON b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
steps AS (
  SELECT p.r, l.lvl, coalesce(s.d, '') AS d, (p.pos >> l.lvl) % 2 AS odd FROM p JOIN low l ON l.tree = p.tree AND l.pos = p.pos >> l.lvl AND l.n > 1
  LEFT JOIN low s ON s.tree = l.tree AND s.lvl = l.lvl AND s.pos = xor(l.pos, 1)
  UNION ALL
  SELECT p.r, sub.depth + l.lvl, coalesce(s.d, ''), (sub.pos >> l.lvl) % 2 FROM p JOIN sub USING (tree) JOIN high l ON l.pos = sub.pos >> l.lvl AND l.n > 1
  LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(l.pos, 1)),
proofs AS (SELECT r, list({'d': d, 'odd': odd} ORDER BY lvl) AS path, string_agg(d, '' ORDER BY lvl) AS proof FROM steps GROUP BY r),
fold(r, i, d) AS (
  SELECT r, 0, CASE WHEN (@CRC@) % 7 = 0 THEN other ELSE leaf END FROM p
  UNION ALL
  SELECT fold.r, i + 1, sha256(CASE WHEN path[i + 1].odd = 1 THEN path[i + 1].d || fold.d ELSE fold.d || path[i + 1].d END) FROM fold JOIN proofs ON proofs.r = fold.r WHERE i < len(path)),
done AS (SELECT r, arg_max(d, i) AS folded_root FROM fold GROUP BY r)
SELECT p.doc_id, p.leaf, sub.d AS subroot, root.d AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root.d AS verified
FROM p JOIN sub USING (tree) JOIN (SELECT d FROM high WHERE n = 1) root ON true LEFT JOIN proofs USING (r) JOIN done USING (r)
""".replace("@CRC@", CRC_SQL)

ORACLE_SQL = {"op13_merkle_manifest": OP13_SQL, "op5_warc": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_benchmark_decontamination": OP7_SQL}
