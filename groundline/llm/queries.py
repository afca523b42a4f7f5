"""The operators' queries over the given tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, mixing, simhash, substring_dedup, suffix_dedup, token_output, toxicity, warc

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_chat_format": chat.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

SQL = {**chat.SQL, **warc.SQL, **exact_dedup.SQL, **mixing.SQL}
