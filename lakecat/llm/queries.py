"""The queries of the ten operators: name -> callable(spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from lakecat.llm import bpe, chat, decontam, html, langid, quality, rules, simhash, substring, tokenstore

QUERIES = {
    "op1_token_store": tokenstore.query,
    "op2_bpe_pair_index": bpe.query,
    "op3_substring_dedup": substring.query,
    "op4_quality_classifier": quality.query,
    "op5_quality_rules": rules.query,
    "op6_decontamination": decontam.query,
    "op7_chat_format": chat.query,
    "op8_html_layout": html.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_language_id": langid.query,
}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": substring.SQL,
    "op5_quality_rules": rules.sql(),
    "op7_chat_format": chat.SQL,
}
