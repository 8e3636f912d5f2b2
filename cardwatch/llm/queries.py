"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from cardwatch.llm import bpe, decontaminate, exact, infill, lines, mixing, neardup, sharding, tokenfiles, toxicity, unigram, urls, whiten

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_token_counts": unigram.op2_token_counts,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_shard": sharding.op5_shard,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_url_filter": urls.op7_url_filter,
    "op8_minhash": neardup.op8_minhash,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_bpe": bpe.op12_bpe,
    "op13_whiten": whiten.op13_whiten,
}

ORACLE = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op5_shard": sharding.OP5_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
}
