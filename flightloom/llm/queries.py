"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import divergence, exact_dedup, images, interactions, language_id, licences, minhash, mixing, pii, sentencepiece_bpe, suffix_array, suffix_tree, vptree

QUERIES = {
    "op6_image_copies": images.op6,
    "op2_licence_scan": licences.op2,
    "op3_vptree_neighbours": vptree.op3,
    "op10_pii_pseudonyms": pii.op10,
    "op9_pfair_mixing": mixing.op9,
    "op8_language_id": language_id.op8,
    "op4_sentencepiece": sentencepiece_bpe.op4,
    "op1_suffix_array_dedup": suffix_array.op1,
    "op5_suffix_tree_dedup": suffix_tree.op5,
    "op7_minhash_near_dedup": minhash.op7,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_divergence_audit": divergence.op12,
    "op13_filter_interactions": interactions.op13,
}

ORACLES: dict[str, str] = {
    "op2_licence_scan": licences.oracle(),
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_divergence_audit": divergence.ORACLE,
    "op13_filter_interactions": interactions.ORACLE,
}
