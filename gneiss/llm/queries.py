"""The numbered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from . import embeddings, fingerprints, lines, minhash, mixing, negatives, packing, pages, phrases, scoring, substrings, tokens, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
        "op9_lm_scoring": scoring.op9_lm_scoring,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_collocations": phrases.op11_collocations,
        "op12_html_extraction": pages.op12_html_extraction,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.OP1_SQL,
        "op2_minhash_near_dedup": minhash.OP2_SQL,
        "op3_substring_dedup": substrings.OP3_SQL,
        "op8_embedding_near_dedup": embeddings.OP8_SQL,
        "op11_collocations": phrases.OP11_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
