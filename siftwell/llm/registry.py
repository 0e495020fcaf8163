"""Queries of this subpackage and, where SQL can express them, their SQL."""

from siftwell.llm import decontamination, embedding_dedup, exact_dedup, fill_in_middle, hard_negatives, html_extraction, language_id, ngram_join, piece_encoding, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_warc": warc.op6_warc,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_piece_encoding": piece_encoding.op9_piece_encoding,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_embedding_dedup": embedding_dedup.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
