"""Queries of the training-data operators and their check SQL."""

from tabwright.llm import (
    bpe,
    code_compression,
    embedding_dedup,
    exact_dedup,
    fill_in_middle,
    langid,
    minhash,
    mixture,
    pii,
    segment_bpe,
    substring_dedup,
    token_files,
    url_filter,
)

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_source_mix": mixture.op4_source_mix,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_private_data": pii.op7_private_data,
    "op8_bpe": bpe.op8_bpe,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_token_files": token_files.op10_token_files,
    "op11_code_compression": code_compression.op11_code_compression,
    "op12_segment_bpe": segment_bpe.op12_segment_bpe,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLES = {
    "op2_minhash_dedup": minhash.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_source_mix": mixture.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op11_code_compression": code_compression.OP11_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
