"""The queries of this folder, and their SQL where there is one."""

from __future__ import annotations

from topoprofile.llm import ann, chat_format, mixing, pieces, quality, secret_scan, simhash, suffix_dedup, token_files, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_warc": warc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_files": token_files.op5_token_files,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_nearest": ann.op7_nearest,
    "op8_pieces": pieces.op8_pieces,
    "op9_poisson_mix": mixing.op9_poisson_mix,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE,
    "op3_warc": warc.ORACLE,
    "op9_poisson_mix": mixing.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
