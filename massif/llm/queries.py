"""Queries of the training-text operators, and the SQL that they are held against."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_decontaminate": "decontaminate",
    "op2_jaccard": "jaccard",
    "op3_language": "language",
    "op4_pii": "pii",
    "op5_passages": "passages",
    "op6_secrets": "secrets",
    "op7_warc": "warc",
    "op8_chat_format": "chat",
    "op9_quality_rules": "quality",
    "op10_byte_bpe": "bpe",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {k: v for k, v in sql.ORACLE.items() if k in NAMES}
