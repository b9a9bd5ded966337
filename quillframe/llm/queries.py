"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from quillframe.llm import fertility, language_id, licenses, line_dedup, order_minhash, packing, simhash, suffix_dedup, token_files, word_bpe
from quillframe.llm.common import read_documents


def op1_suffix_array(spark, sf_dir):
    out = suffix_dedup.dedup_bytes(spark, read_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_order_minhash(spark, sf_dir):
    return order_minhash.fingerprints_and_edits(spark, read_documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return word_bpe.encode_documents(spark, read_documents(spark, sf_dir))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(spark, read_documents(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(spark, read_documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return packing.pack(spark, read_documents(spark, sf_dir))


def op7_token_files(spark, sf_dir):
    return token_files.write_and_read(spark, read_documents(spark, sf_dir))


def op8_language_id(spark, sf_dir):
    return language_id.identify(spark, read_documents(spark, sf_dir))


def op9_licenses(spark, sf_dir):
    return licenses.scan(spark, read_documents(spark, sf_dir))


def op10_fertility(spark, sf_dir):
    return fertility.quality(spark, read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_order_minhash, op3_bpe, op4_simhash, op5_packing, op6_line_dedup, op7_token_files, op8_language_id, op9_licenses, op10_fertility)}
ORACLES: dict[str, str] = {"op9_licenses": licenses.oracle_sql()}
