"""One registered query per operator, over whole tables, and the SQL where there is any."""

import public_tokenizers
from pyspark.sql import functions as F

from tamhis.llm import (
    byte_bpe, conversation_repair, decontamination, embedding_dedup, language_id, language_model, packing, quality, ranked_search, simhash, token_counts, toxicity, url_filter,
)
from tamhis.llm.common import held_out
from tamhis.workspace import written


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    pieces = token_counts.read_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op2_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out("doc_id", 3, 1)).select("text", "lang"))
    return language_id.identify(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The rules of the query.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_benchmark_decontamination(spark, sf_dir):
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_model_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_model.score_texts(docs, ~held_out("doc_id", 5, 1)).select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_packing(spark, sf_dir):
    tokenizer = packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.filter(~held_out("doc_id", 3, 1)), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def damaged(rows):
    """Conversations with faults: by a number of each row it is dropped (0), emptied (1), loses its full stops (2), is
    repeated (3) or becomes the user's (4)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat_ws(":", text["conv_id"], text["turn"]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), fault.alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    fixed = conversation_repair.repair(damaged(rows))
    out = rows.select("conv_id").distinct()
    for part in (fixed.conversations, conversation_repair.transcripts(fixed.messages)):
        part = part.withColumnRenamed("conv_id", "own_id")
        out = out.join(part, out["conv_id"].eqNullSafe(part["own_id"]), "left").drop("own_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    result = written(out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repaired")
    fixed.release()
    return result


def op13_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_embedding_near_dedup, op3_simhash_near_dedup, op4_language_id, op5_toxicity, op6_url_filter, op7_benchmark_decontamination, op8_language_model_scoring, op9_packing, op10_quality,
    op11_ranked_search, op12_conversation_repair, op13_byte_bpe,
)}
ORACLE_SQL = {
    "op11_ranked_search": """
        WITH doc AS (
            SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM documents),
        item AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        tf AS (SELECT row, doc_id, term, count(*) AS tf FROM doc GROUP BY ALL),
        size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        weight AS (
            SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, total GROUP BY term),
        asked AS (SELECT item_id, term, count(*) AS q FROM item GROUP BY ALL),
        scored AS (
            SELECT item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (row), total GROUP BY ALL)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20""",
    "op2_embedding_near_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
            ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)""",
}
