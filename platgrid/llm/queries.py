"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, licences, linededup, mixing, quality, simhash, substring, warc, webp

QUERIES = {
    "op1_lossless_webp": webp.op1,
    "op2_license_scan": licences.op2,
    "op3_chat_formatting": chat.op3,
    "op4_line_dedup": linededup.op4,
    "op5_benchmark_decontamination": decontam.op5,
    "op6_quality_classifier": quality.op6,
    "op7_mixing_sources": mixing.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_substring_dedup": substring.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL = {
    "op1_lossless_webp": webp.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
    "op5_benchmark_decontamination": decontam.OP5_SQL,
    "op7_mixing_sources": mixing.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
}
