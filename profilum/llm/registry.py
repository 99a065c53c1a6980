"""Queries of the text operators and their SQL twins."""

from profilum.llm import chat, decontam, flac, jaccard, licenses, quality, sampling, substrings, token_counts, toxicity

QUERIES = {
    "op1_media_columns": flac.op1_media_columns,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sentencepiece_sampling": sampling.op4_sentencepiece_sampling,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_token_counts": token_counts.op8_token_counts,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
}
ORACLES = {
    "op2_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op6_substring_dedup": substrings.ORACLE_SQL,
    "op7_license_scans": licenses.ORACLE_SQL,
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op9_benchmark_decontamination": decontam.ORACLE_SQL,
}
