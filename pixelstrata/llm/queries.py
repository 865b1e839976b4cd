"""The operators of this package over their whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from pixelstrata.llm import chat_windows, embedding_links, fill_middle, html_templates, language_models, packing, phrase_index, projected_search, quality, sentence_pieces, spelling_variants, tensor_minhash, warc

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_templates.extract(_table(spark, sf_dir, "pages"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows; conversation -1 holds control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], given.schema)
    return chat_windows.read_back(chat_windows.windows(given.unionByName(added)))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embedding_links.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip."""
    return sentence_pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors = _table(spark, sf_dir, "embeddings")
    return projected_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: shingles of three words, similarity 0.85 or more."""
    return tensor_minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    return language_models.languages(_table(spark, sf_dir, "documents"))


def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_middle.transform(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = phrase_index.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = phrase_index.hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {
    "op1_quality_classifier": quality_classifier,
    "op2_html_extraction": html_extraction,
    "op3_warc_round_trip": warc_round_trip,
    "op4_chat_formatting": chat_formatting,
    "op5_embedding_near_dedup": embedding_near_dedup,
    "op6_best_fit_packing": best_fit_packing,
    "op7_sentencepiece_encoding": sentencepiece_encoding,
    "op8_minhash_near_dedup": minhash_near_dedup,
    "op9_nearest_neighbours": nearest_neighbours,
    "op10_language_id": language_id,
    "op11_spelling_variants": spelling_groups,
    "op12_fill_in_middle": fill_in_middle,
    "op13_benchmark_decontamination": benchmark_decontamination,
    "pipeline": corpus_pipeline.run,
}
ORACLES["op12_fill_in_middle"] = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS tail FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(head)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM p"""
ORACLES["op13_benchmark_decontamination"] = r"""
    WITH low AS (SELECT 0 AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        UNION ALL SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    split AS (SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
    item AS (SELECT id, w, least(len(w), 10) AS n FROM split WHERE kind = 1 AND len(w) > 0),
    phrase AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM item)),
    place AS (SELECT id AS doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM split WHERE kind = 0),
    win AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM place, (SELECT DISTINCT n FROM item) WHERE k + n - 1 <= len(w)),
    found AS (SELECT doc_id, k, n, item_id FROM win JOIN phrase USING (n, p)),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
    SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM split LEFT JOIN hit ON hit.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 0"""
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
