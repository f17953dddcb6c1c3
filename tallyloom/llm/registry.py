"""Queries of this subpackage, by name, and their SQL where SQL can say the same."""

import corpus_pipeline

from . import exact_dedup, line_dedup, mixing, packing, quality, repetition, simhash, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_repetition_rules": repetition.op1_repetition_rules,
    "op2_length_packing": packing.op2_length_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
#: The others rest on trained models, seeded draws, dynamic programming, or verdicts that SQL cannot give on whole tables.
SQL = {
    "op1_repetition_rules": repetition.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_suffix_dedup": suffix_dedup.OP7_SQL,
}
