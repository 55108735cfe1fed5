"""The registered queries of the training-text operators and their SQL."""

from . import chat_format, clustering, decontamination, exact_dedup, language_id, merkle, mixing, near_dedup, quality, sharding, simhash, token_counts, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_chat_formatting": chat_format.op7_chat_formatting,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_simhash": simhash.op12_simhash,
    "op13_centroids": clustering.op13_centroids,
}

ORACLE_SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_chat_formatting": chat_format.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_centroids": clustering.OP13_SQL,
}
