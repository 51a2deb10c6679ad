"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, divergence, fuzzy_hash, golay_simhash, kn_quality, lang_id, license_scan, near_dup, periodic_runs, pieces, shard, token_store, url_filter
from .common import read_table, shared_folder


def op1_url_filters(spark, sf_dir):
    """A page counts as bad where the label of its number says low quality or toxic."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.select("page_id", "url").join(bad, "page_id").select("url", "blocked")
    return url_filter.url_filter(pages, labelled)


def op2_license_scan(spark, sf_dir):
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents")).drop("n_equal")


def op4_decontamination(spark, sf_dir):
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op5_token_store(spark, sf_dir):
    folder = shared_folder(spark)
    token_store.write_store(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.digests(spark, folder)


def op6_feistel_shards(spark, sf_dir):
    return shard.shard_rows(read_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return pieces.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_fuzzy_fingerprints(spark, sf_dir):
    return fuzzy_hash.fingerprints(read_table(spark, sf_dir, "documents"))


def op9_kn_quality(spark, sf_dir):
    return kn_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return lang_id.language_of(docs, lang_id.learn(docs))


def op11_simhash(spark, sf_dir):
    return golay_simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted(read_table(spark, sf_dir, "documents"))))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (
        op1_url_filters, op2_license_scan, op3_near_duplicates, op4_decontamination, op5_token_store, op6_feistel_shards,
        op7_sentencepiece, op8_fuzzy_fingerprints, op9_kn_quality, op10_language_id,
        op11_simhash, op12_source_divergence, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql():
    return {
        "op2_license_scan": license_scan.oracle(), "op3_near_duplicates": near_dup.oracle(), "op4_decontamination": decontaminate.oracle(), "op6_feistel_shards": shard.oracle(),
        "op12_source_divergence": divergence.oracle(), "op13_periodic_runs": periodic_runs.oracle(),
    }
