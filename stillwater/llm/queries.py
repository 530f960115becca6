"""Queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from .embedding_dedup import op10_collision_counting
from .exact_dedup import OP5_SQL, op5_block_naming_dedup
from .language_id import op3_rank_order_language
from .ngram_join import op7_parity_sketch_join
from .ngram_trie import op1_elias_fano_trie
from .packing import op9_bin_completion
from .piece_viterbi import op6_streaming_viterbi
from .suffix_dedup import op8_lyndon_suffix_dedup
from .token_counts import op4_separator_scan
from .url_reputation import OP2_SQL, op2_host_reputation

QUERIES = {
    f.__name__: f
    for f in (op1_elias_fano_trie, op2_host_reputation, op3_rank_order_language, op4_separator_scan, op5_block_naming_dedup, op6_streaming_viterbi, op7_parity_sketch_join, op8_lyndon_suffix_dedup, op9_bin_completion, op10_collision_counting)
}
SQL = {"op2_host_reputation": OP2_SQL, "op5_block_naming_dedup": OP5_SQL}
