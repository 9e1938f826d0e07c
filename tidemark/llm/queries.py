"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import divergence
from tidemark.llm import quality_rules as rules
from tidemark.llm.common import table
from tidemark.llm.fingerprints import fingerprints
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.licenses import licence_scan
from tidemark.llm.mixing import mixing_rates
from tidemark.llm.ordinal import ordinal_quality
from tidemark.llm.packing import packed
from tidemark.llm.secret_scans import secret_scan
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_output import token_output
from tidemark.llm.toxicity import toxicity
from tidemark.llm.whitening import whitened


def op1_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_quality_rules(spark, sf_dir):
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op5_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return ordinal_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scans(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_secret_scans(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_jaccard_join, op4_best_fit_packing, op5_fingerprints, op6_quality_classifier, op7_source_mixing, op8_license_scans, op9_toxicity, op10_token_counts, op11_secret_scans, op12_source_divergence, op13_embedding_whitening)}
ORACLE_SQL = {"op2_quality_rules": rules.oracle_sql(), "op12_source_divergence": divergence.oracle_sql()}
