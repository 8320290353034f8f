"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from webmill.llm.audit import OP12_SQL, op12_filter_audit
from webmill.llm.bpe import op1_token_counts, op2_bpe
from webmill.llm.ctw import op8_lm_scoring
from webmill.llm.jaccard import OP5_SQL, op5_jaccard_join
from webmill.llm.mixing import op10_source_mixing
from webmill.llm.neighbours import OP9_SQL, op9_embedding_near_dedup
from webmill.llm.quality import OP4_SQL, op4_quality_rules
from webmill.llm.substrings import OP3_SQL, OP7_SQL, op3_suffix_dedup, op7_substring_dedup
from webmill.llm.topk import OP13_SQL, op13_top_k
from webmill.llm.toxicity import op6_toxicity
from webmill.llm.trie import OP11_SQL, op11_prefix_trie

OPERATORS = (
    op1_token_counts,
    op2_bpe,
    op3_suffix_dedup,
    op4_quality_rules,
    op5_jaccard_join,
    op6_toxicity,
    op7_substring_dedup,
    op8_lm_scoring,
    op9_embedding_near_dedup,
    op10_source_mixing,
    op11_prefix_trie,
    op12_filter_audit,
    op13_top_k,
)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
#: The others have no SQL form: tests hold them against the libraries, plain Python or held-out rows.
ORACLE_SQL = {
    "op3_suffix_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_top_k": OP13_SQL,
}
