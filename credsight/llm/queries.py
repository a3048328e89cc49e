"""Queries of the training-data operators and, where SQL expresses them, their DuckDB text."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op2_byte_bpe
from .chat import OP6_SQL, op6_chat_format
from .crosspolytope import op13_nearest_neighbours
from .fingerprint import op8_order_minhash
from .langid import op10_language_id
from .licenses import op4_license_scan
from .minhash import OP7_SQL, op7_minhash_near_dedup
from .mixing import op9_source_mix
from .quality import op3_quality_rules
from .runs import OP11_SQL, op11_periodic_runs
from .secrets import OP5_SQL, op5_secret_scan
from .substring import OP1_SQL, op1_substring_dedup
from .trie import OP12_SQL, op12_conversation_trie

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_format": op6_chat_format,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_order_minhash": op8_order_minhash,
    "op9_source_mix": op9_source_mix,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op5_secret_scan": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
