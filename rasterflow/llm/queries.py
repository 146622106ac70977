"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bpe, chat, decontamination, digest, importance, lexical, mixing, mpegts, pii, simhash, token_files, toxicity
from .common import documents, word_count


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's number of tokens, from files that hold nothing but ids. Null and empty texts: 0; repeated rows and null ids: a result each; empty table: no rows."""
    return token_files.token_counts(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's fingerprint and component. Null and empty texts: fingerprint zero; null ids: a result each; empty table: no rows."""
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False).select("doc_id", "fingerprint", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every row. Null texts: size 0; null sources: one source, last; repeated rows: copies of their own; empty table: no rows."""
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_copies(sized, size=F.col("words"))
    return mixed.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op4_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every row's ids lie, and their check value, from files of planes. Null and empty texts: the end id; null ids come first; empty table: no rows."""
    return bitplanes.token_planes(documents(spark, sf_dir))


def op5_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parse of every row's stored stream gives. Null and empty texts: 64 zeros; repeated rows: a result each; empty table: no rows."""
    found = mpegts.media_features(mpegts.store_media(documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "points")


def op6_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next. Null texts: empty; null ids stand last; rows with equal ids in order of the digest of their text; empty table: no rows."""
    return digest.edited_fingerprints(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's score by a lexicon that is learned outside the held-out fold. Null and empty texts: no evidence; null ids: held out; empty table: no rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's ids and what they decode to, as digests. Null and empty texts: no tokens; repeated rows: a result each; empty table: no rows."""
    return bpe.encode_documents(documents(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, folded from a log of drafts, edits, regenerations and deltas, rendered and read back. Null roles and texts: empty; null ids: one conversation; equal turns: messages of their own."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    read = chat.parse(chat.format_log(chat.streamed_log(turns.unionByName(extra))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates, and the number of entities. Null and empty texts: unchanged, 0; repeated rows: alike; empty table: no rows."""
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), count="n_entities")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item. Null and empty texts: found by none; null ids: last of equal scores; repeated rows: a rank each; empty table: no rows."""
    return lexical.search(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every row stand in benchmark windows. Null and empty texts: no words, clean; repeated rows and null ids: a result each; empty table: no rows."""
    marked = decontamination.contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's weight by the benchmark's n-grams, and the rank of those drawn. Null and empty texts: weight 0, undrawn; null ids: the deviate of the empty id; repeated rows: a result each; empty table: no rows."""
    drawn = importance.resample(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_mixing, op4_bitplanes, op5_mpegts, op6_exact_digest, op7_toxicity, op8_byte_bpe, op9_chat, op10_pii, op11_lexical_search, op12_decontamination, op13_importance)}

ORACLE_SQL = {
    "op9_chat": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), put AS (
    SELECT *, '<s>[INST] ' || regexp_replace(role, '([<\[\\])', '\1\\', 'g') || ' [/INST] '
        || regexp_replace(text, '([<\[\\])', '\1\\', 'g') || ' </s>' || chr(10) AS formatted
    FROM turns
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(formatted))::BIGINT AS formatted_chars
FROM put GROUP BY conv_id
""",
    "op11_lexical_search": r"""
WITH terms AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), stats AS (
    SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM terms
), tf AS (
    SELECT r, doc_id, len(t)::BIGINT AS words, term, count(*)::BIGINT AS tf FROM (SELECT *, unnest(t) AS term FROM terms) GROUP BY ALL
), df AS (
    SELECT term, floor(1000 * ln((2 * max(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, stats GROUP BY term
), q AS (
    SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (
    SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * words * n) // l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL
), k AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op12_decontamination": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS txt FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), stretch AS (
    SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS txt FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
    SELECT DISTINCT r, s, n, item FROM stretch JOIN win USING (n, txt)
), words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
    "op13_importance": r"""
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) x(i)
), texts AS (
    SELECT row_number() OVER () AS r, 'd' AS side, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 'b', NULL, text FROM benchmark
), d AS (
    SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
    SELECT side, r, array_to_string(w[s:s + n - 1], ' ') AS g, count(*)::BIGINT AS times FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, range(1, 4) x(n) WHERE len(w) >= n) GROUP BY ALL
), bucket AS (
    SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || hex(encode(g))[2 * i - 1:2 * i])::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS b FROM (SELECT DISTINCT g FROM grams), crc_table
), counts AS (
    SELECT b, sum(times) FILTER (side = 'd') AS s, sum(times) FILTER (side = 'b') AS t FROM grams JOIN bucket USING (g) GROUP BY b
), gains AS (
    SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weights AS (
    SELECT r, sum(times * gain)::BIGINT AS weight, sum(times)::BIGINT AS n_features FROM grams JOIN bucket USING (g) JOIN gains USING (b) WHERE side = 'd' GROUP BY r
), scored AS (
    SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r) WHERE side = 'd'
), ranked AS (
    SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS k, count(*) FILTER (words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN k <= 5 * n // 100 THEN k END::BIGINT AS rank FROM ranked
""",
}
