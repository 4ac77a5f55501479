"""The registered queries of this package and their DuckDB SQL."""

from . import decontamination, jaccard_join, quality, secrets, sentencepiece_codec, sharding, suffix_dedup, token_counts, topk_search, toxicity, url_filters, vector_codes, whitening

QUERIES = {
    "op1_exact_topk_search": topk_search.op1_exact_topk_search,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_consistent_hash_sharding": sharding.op3_consistent_hash_sharding,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_suffix_array_dedup": suffix_dedup.op12_suffix_array_dedup,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {
    "op1_exact_topk_search": topk_search.OP1_SQL,
    "op5_url_filters": url_filters.OP5_SQL,
    "op6_secret_scans": secrets.OP6_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_ngram_jaccard_join": jaccard_join.OP10_SQL,
    "op12_suffix_array_dedup": suffix_dedup.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
