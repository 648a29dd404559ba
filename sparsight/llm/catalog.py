"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import codes, search, trie
from .codes import op12_partial_distance_codes
from .fingerprints import op3_iblt_fingerprints
from .html import op8_dom_marginals
from .jaccard import op2_count_vector_join
from .languages import op7_cross_parsing
from .packing import op4_matched_packing
from .scoring import op10_trie_scores
from .search import op6_maxscore_neighbours
from .secrets import op9_randomness_scan
from .sharding import op1_hypergeometric_shards
from .simhash import op13_vantage_point_copies
from .tokens import op5_bpe_roundtrip
from .trie import op11_louds_prefix_trie


def queries() -> dict:
    own = [
        op1_hypergeometric_shards, op2_count_vector_join, op3_iblt_fingerprints, op4_matched_packing, op5_bpe_roundtrip,
        op6_maxscore_neighbours, op7_cross_parsing, op8_dom_marginals, op9_randomness_scan, op10_trie_scores,
        op11_louds_prefix_trie, op12_partial_distance_codes, op13_vantage_point_copies,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the others are tested against brute force, round trips and held-out rows."""
    return {"op6_maxscore_neighbours": search.ORACLE, "op11_louds_prefix_trie": trie.ORACLE, "op12_partial_distance_codes": codes.ORACLE}
