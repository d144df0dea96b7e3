"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, jaccard, licenses, media, packing, pii, quality, shards, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_url_filters": urls.op5_url_filters,
    "op6_license_scans": licenses.op6_license_scans,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_media_columns": media.op9_media_columns,
    "op10_token_output": shards.op10_token_output,
}

ORACLE: dict[str, str] = {
    "op3_chat_formatting": chat.SQL_OP3,
    "op5_url_filters": urls.SQL_OP5,
    "op6_license_scans": licenses.sql(),
    "op8_quality_rules": quality.sql(),
}
