"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loomwright.llm.bpe import op3_segment_tree_bpe
from loomwright.llm.exact_dedup import OP2_SQL, op2_tree_merge_exact_dedup
from loomwright.llm.line_dedup import op6_deletion_neighbourhood_line_dedup
from loomwright.llm.minhash import op10_circulant_minhash_near_dedup
from loomwright.llm.ngram import op1_elias_fano_ngram_scoring
from loomwright.llm.packing import op9_martello_toth_best_fit_packing
from loomwright.llm.pii import op13_boosted_candidate_pii
from loomwright.llm.sharding import op4_permutation_table_sharding, op4_sql
from loomwright.llm.spelling import OP12_SQL, op12_rare_first_spelling_variants
from loomwright.llm.toxicity import op5_classifier_chain_toxicity
from loomwright.llm.vector_codes import op11_partial_distance_vector_codes, op11_sql
from loomwright.llm.warc import op8_warc_derivatives
from loomwright.llm.winnowing import op7_winnowing_fingerprints

QUERIES = {
    "op1_elias_fano_ngram_scoring": op1_elias_fano_ngram_scoring,
    "op2_tree_merge_exact_dedup": op2_tree_merge_exact_dedup,
    "op3_segment_tree_bpe": op3_segment_tree_bpe,
    "op4_permutation_table_sharding": op4_permutation_table_sharding,
    "op5_classifier_chain_toxicity": op5_classifier_chain_toxicity,
    "op6_deletion_neighbourhood_line_dedup": op6_deletion_neighbourhood_line_dedup,
    "op7_winnowing_fingerprints": op7_winnowing_fingerprints,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_martello_toth_best_fit_packing": op9_martello_toth_best_fit_packing,
    "op10_circulant_minhash_near_dedup": op10_circulant_minhash_near_dedup,
    "op11_partial_distance_vector_codes": op11_partial_distance_vector_codes,
    "op12_rare_first_spelling_variants": op12_rare_first_spelling_variants,
    "op13_boosted_candidate_pii": op13_boosted_candidate_pii,
}


def oracle() -> dict[str, str]:
    return {
        "op2_tree_merge_exact_dedup": OP2_SQL,
        "op4_permutation_table_sharding": op4_sql(),
        "op11_partial_distance_vector_codes": op11_sql(),
        "op12_rare_first_spelling_variants": OP12_SQL,
    }
