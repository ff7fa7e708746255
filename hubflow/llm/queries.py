"""The registered ``opN_`` queries of this package and their DuckDB SQL.

Operators that SQL can't express have no SQL here; ``tests/llm`` holds them
against brute force."""

from __future__ import annotations

from .bytesuffix import op5_suffix_dedup
from .decontaminate import op3_decontaminate
from .filteraudit import OP13_SQL, op13_filter_audit
from .langid import op2_language_id
from .linerun import OP7_SQL, op7_line_runs
from .mixing import op6_mix
from .prefixtrie import OP11_SQL, op11_prefix_trie
from .quality import op9_quality_rules
from .sharding import op4_shuffled_shards
from .simhash import op1_simhash
from .topk import OP12_SQL, op12_top_k
from .warc import OP8_SQL, op8_warc
from .wordtree import op10_substring_dedup

LLM_QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_shuffled_shards": op4_shuffled_shards,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix": op6_mix,
    "op7_line_runs": op7_line_runs,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_top_k": op12_top_k,
    "op13_filter_audit": op13_filter_audit,
}

LLM_ORACLE_SQL: dict[str, str] = {"op7_line_runs": OP7_SQL, "op8_warc": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_top_k": OP12_SQL, "op13_filter_audit": OP13_SQL}
