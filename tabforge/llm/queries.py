"""Registered queries of the operators, their fixed result columns, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.plans.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query(rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORD_SQL}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORD_SQL}') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM il, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM dw, ks, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
hit AS (SELECT DISTINCT doc_id, dp.k, i, item_id FROM dp JOIN win ON win.k = dp.k AND win.t = dp.t),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
ni AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""")
def op1_decontamination(spark, sf_dir):
    from tabforge.llm.decontam import contaminated
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")


@query(r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY cp DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY s) AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY cp DESC, doc_id) = 1 AS kept, sha256(s) AS text_sha256 FROM n""")
def op5_exact_dedup(spark, sf_dir):
    from tabforge.llm.exact_dedup import exact_dedup
    return exact_dedup(load(spark, sf_dir, "documents"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UP}', '{LOW}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keep AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY 1""")
def op8_line_dedup(spark, sf_dir):
    from tabforge.llm.line_dedup import line_dedup
    return line_dedup(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op10_license_scan(spark, sf_dir):
    from tabforge.llm.license_scan import license_scan
    return license_scan(load(spark, sf_dir, "documents"))


@query()
def op9_simhash_dedup(spark, sf_dir):
    from tabforge.llm.simhash import simhash_dedup
    return simhash_dedup(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op7_bpe(spark, sf_dir):
    from tabforge.llm.bpe import bpe_encode
    return bpe_encode(load(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op6_toxicity(spark, sf_dir):
    from tabforge.llm.toxicity import is_held_out, score, train
    docs = load(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), train(docs, load(spark, sf_dir, "labels"))).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op3_token_count(spark, sf_dir):
    """Flat token files of ``documents``, counted; a file holds the rows of one partition of the scan in order."""
    import uuid

    from tabforge.llm.token_count import count_tokens, write_token_files
    from tabforge.session import ensure_checkpoint_dir
    docs = load(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4()}"
    write_token_files(docs, tokenizer_path(), path)
    row = F.monotonically_increasing_id()
    ids = docs.select("doc_id", F.shiftright(row, 33).alias("file_no"), row.bitwiseAND((1 << 33) - 1).alias("doc_no"))
    counts = count_tokens(spark, path)
    return counts.withColumn("file_no", F.regexp_extract("path", r"part-(\d+)", 1).cast("long")).join(
        ids, ["file_no", "doc_no"]).select("doc_id", "file_no", "doc_no", "first_token", "n_tokens")


@query()
def op4_pseudonyms(spark, sf_dir):
    from tabforge.llm.pii import pseudonymise
    return pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), "pseudonym-key-1")


@query()
def op2_suffix_dedup(spark, sf_dir):
    from tabforge.llm.suffix_dedup import remove_repeats
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


@query()
def op11_document_fingerprints(spark, sf_dir):
    from tabforge.llm.merkle import fingerprint_edits
    return fingerprint_edits(load(spark, sf_dir, "documents"))


@query("""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(spark, sf_dir):
    from tabforge.llm.hard_negatives import hard_negatives
    return hard_negatives(load(spark, sf_dir, "embeddings"))


@query()
def op12_token_alignment(spark, sf_dir):
    from tabforge.llm.token_align import token_alignment
    return token_alignment(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
