"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from .byte_bpe import op12_two_tier_bpe
from .exact_dedup import OP6_SQL, op6_patricia_owners
from .language_id import op5_nearest_centroid
from .lm_scoring import (
    OP9_SQL,
    TRIGRAM_SQL,
    UNDER_SQL,
    WHOLE_SQL,
    op9_stupid_backoff,
    op9_under_conversations,
    op9_whole_backoff,
    op9_whole_trigrams,
)
from .mixing import TARGETS_SQL, op8_entropy_balance, op8_targets
from .ngram_join import OP3_SQL, op3_tiled_jaccard
from .packing import op2_min_bin_slack
from .quality_rules import op4_decision_list
from .ranked_search import OP11_SQL, op11_tput_search
from .sharding import op1_consistent_ring
from .spelling import OP13_SQL, op13_trie_variants
from .token_matrix import op7_best_fit_matrix
from .toxicity import op10_boosted_trees

QUERIES = {
    "op1_consistent_ring": op1_consistent_ring,
    "op2_min_bin_slack": op2_min_bin_slack,
    "op3_tiled_jaccard": op3_tiled_jaccard,
    "op4_decision_list": op4_decision_list,
    "op5_nearest_centroid": op5_nearest_centroid,
    "op6_patricia_owners": op6_patricia_owners,
    "op7_best_fit_matrix": op7_best_fit_matrix,
    "op8_entropy_balance": op8_entropy_balance,
    "op8_targets": op8_targets,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op9_whole_backoff": op9_whole_backoff,
    "op9_whole_trigrams": op9_whole_trigrams,
    "op9_under_conversations": op9_under_conversations,
    "op10_boosted_trees": op10_boosted_trees,
    "op11_tput_search": op11_tput_search,
    "op12_two_tier_bpe": op12_two_tier_bpe,
    "op13_trie_variants": op13_trie_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_tiled_jaccard": OP3_SQL,
    "op8_targets": TARGETS_SQL,
    "op6_patricia_owners": OP6_SQL,
    "op9_stupid_backoff": OP9_SQL,
    "op9_whole_backoff": WHOLE_SQL,
    "op9_whole_trigrams": TRIGRAM_SQL,
    "op9_under_conversations": UNDER_SQL,
    "op11_tput_search": OP11_SQL,
    "op13_trie_variants": OP13_SQL,
}
