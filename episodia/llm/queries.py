"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from episodia.llm.context_tree import op12_context_tree
from episodia.llm.decontamination import op2_template_windows
from episodia.llm.language_id import op1_chain_field
from episodia.llm.line_dedup import op10_line_runs
from episodia.llm.merkle_manifest import OP11_SQL, op11_path_copying
from episodia.llm.mixing import OP4_SQL, op4_hash_thresholds
from episodia.llm.ngram_join import op3_t_occurrence
from episodia.llm.prefix_trie import OP13_SQL, op13_splitter_skeleton
from episodia.llm.sharding import op7_sampled_splitters
from episodia.llm.token_frames import op9_seekable_frames
from episodia.llm.toxicity import op5_gated_recurrent
from episodia.llm.url_rules import OP8_SQL, op8_sorted_sweep
from episodia.llm.vector_dedup import op6_product_quantisation

QUERIES = {f.__name__: f for f in (op1_chain_field, op2_template_windows, op3_t_occurrence, op4_hash_thresholds, op5_gated_recurrent,
                                    op6_product_quantisation, op7_sampled_splitters, op8_sorted_sweep, op9_seekable_frames,
                                    op10_line_runs, op11_path_copying, op12_context_tree, op13_splitter_skeleton)}
SQL = {"op4_hash_thresholds": OP4_SQL, "op8_sorted_sweep": OP8_SQL, "op11_path_copying": OP11_SQL,
       "op13_splitter_skeleton": OP13_SQL}
