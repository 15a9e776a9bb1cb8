"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

#: Query name: the module that has it.
MODULES = {
    "op1_licence_scan": "licences",
    "op2_token_counts": "token_counts",
    "op3_near_dedup": "near_dedup",
    "op4_decontaminate": "decontaminate",
    "op5_token_files": "token_files",
    "op6_language_id": "language_id",
    "op7_byte_bpe": "tiktoken_codec",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_toxicity": "toxicity",
    "op10_media": "media",
    "op11_conversation_repair": "conversation_repair",
    "op12_conversation_trie": "conversation_trie",
    "op13_packing": "packing",
}


def queries() -> dict:
    root = str(Path(__file__).resolve().parents[2])  # where corpus_pipeline.py is, whatever folder Python was started in
    if root not in sys.path:
        sys.path.append(root)
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import conversation_repair, conversation_trie, licences

    return {"op1_licence_scan": licences.sql(), "op11_conversation_repair": conversation_repair.sql(), "op12_conversation_trie": conversation_trie.sql()}
