"""The documents of a corpus, filtered, de-duplicated, decontaminated and packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; decisions are made row by row on
what a row holds, so null and repeated ids are safe. Labels and benchmark items are read from ``sf_dir``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tamhis.llm import decontamination, packing, quality, simhash, toxicity
from tamhis.llm.common import col, fresh
from tamhis.operators.curation import first_per_key
from tamhis.workspace import written


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is below 0.5."""
    score = fresh("toxicity", docs.columns)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, keep=docs.columns, out=score).filter(col(score) < 0.5).drop(score)


def drop_low_quality(spark, docs, sf_dir):
    """Documents whose quality score is 0.5 or more."""
    score = fresh("quality", docs.columns)
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.score(docs, model, keep=docs.columns, out=score).filter(col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark, docs, sf_dir):
    """The document with the smallest id of every group of near-duplicates (rows without an id come last)."""
    fp, component, group = (fresh(n, docs.columns) for n in ("fingerprint_bits", "component_id", "group"))
    found = simhash.near_duplicates(
        docs, words=3, max_bits=2, keep=docs.columns, fingerprint_col=fp, component_col=component, group_col=group)
    order = [F.col("doc_id").asc_nulls_last(), col(fp), F.xxhash64("text")]
    return first_per_key(found, group, order).select(docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
