"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, html_text, jaccard, merkle, mixing, resampling, sharding, simhash, suffix_dedup, tiff, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_site_style_tree": html_text.query,
    "op3_toxicity": toxicity.query,
    "op4_sharding": sharding.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_url_language_models": url_filter.query,
    "op7_bpe": bpe.query,
    "op8_tiff": tiff.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_temperature_mixing": mixing.query,
    "op11_importance_resampling": resampling.query,
    "op12_merkle_manifest": merkle.query,
    "op13_ngram_jaccard_join": jaccard.query,
}

ORACLES = {"op1_exact_dedup": exact_dedup.SQL, "op11_importance_resampling": resampling.SQL, "op12_merkle_manifest": merkle.SQL}
