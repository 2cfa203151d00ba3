"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid

import public_tokenizers

from casemill.llm.bpe import bpe_digests
from casemill.llm.collocations import ORACLE as COLLOCATIONS_SQL
from casemill.llm.collocations import collocations
from casemill.llm.common import made, read_table, shared_dir, staged
from casemill.llm.decontamination import ORACLE as CONTAMINATION_SQL
from casemill.llm.decontamination import contamination
from casemill.llm.fingerprints import edited_fingerprints, with_near_counts
from casemill.llm.html_text import main_text
from casemill.llm.quality import quality
from casemill.llm.simhash import near_duplicates
from casemill.llm.suffix_dedup import repeat_digests
from casemill.llm.token_counts import token_counts
from casemill.llm.token_files import token_file_digests, write_token_files
from casemill.llm.topk_search import ORACLE as TOP_SQL
from casemill.llm.topk_search import top_products
from casemill.llm.toxicity import toxicity
from casemill.llm.whitening import whitening


def op1_suffix_dedup(spark, sf_dir):
    return repeat_digests(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    """A new cache each time, so that every distinct text is encoded."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), made(f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"))


def op3_simhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_toxicity(spark, sf_dir):
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_decontamination(spark, sf_dir):
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("item_ids")


def op7_token_files(spark, sf_dir):
    path = made(f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_file_digests(spark, path)


def op8_fingerprints(spark, sf_dir):
    return with_near_counts(staged(edited_fingerprints(read_table(spark, sf_dir, "documents")), "edited-fingerprints"))


def op9_html_text(spark, sf_dir):
    return main_text(read_table(spark, sf_dir, "pages"))


def op10_bpe(spark, sf_dir):
    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening(read_table(spark, sf_dir, "embeddings"))


def op13_top_products(spark, sf_dir):
    return top_products(read_table(spark, sf_dir, "embeddings"))


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_simhash, op4_quality, op5_toxicity, op6_decontamination, op7_token_files, op8_fingerprints, op9_html_text, op10_bpe, op11_collocations, op12_whitening, op13_top_products)}


def oracle_sql():
    return {"op6_decontamination": CONTAMINATION_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_top_products": TOP_SQL}
