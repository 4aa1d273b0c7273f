"""Queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from barline.llm import decontamination, exact_dedup, line_dedup, mixing, packing, phrases, pitman_yor, quality, secret_scan, simhash, token_edits, toxicity, whitening
from barline.llm.common import read_table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_dedup(read_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark, sf_dir):
    return pitman_yor.lm_score(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_token_edits(spark, sf_dir):
    return token_edits.edited_counts(read_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark, sf_dir):
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_mixing": op3_mixing,
        "op4_simhash": op4_simhash,
        "op5_quality": op5_quality,
        "op6_line_dedup": op6_line_dedup,
        "op7_pitman_yor": op7_pitman_yor,
        "op8_toxicity": op8_toxicity,
        "op9_token_edits": op9_token_edits,
        "op10_packing": op10_packing,
        "op11_whitening": op11_whitening,
        "op12_decontamination": op12_decontamination,
        "op13_phrases": op13_phrases,
    }


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op12_decontamination": decontamination.ORACLE, "op13_phrases": phrases.ORACLE}
