"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .align import op13_token_alignment
from .bpe import op12_bpe_round_trip
from .infill import OP11_SQL, op11_fill_in_middle
from .jaccard import OP4_SQL, op4_jaccard_join
from .linededup import op10_line_dedup
from .lmscore import OP8_SQL, op8_lm_scoring
from .mixing import op1_source_mixing
from .packing import op5_best_fit_packing
from .quality import OP6_SQL, op6_quality_rules
from .secrets import op2_secret_scan
from .urls import op3_url_filter
from .vectors import OP9_SQL, op9_pq_near_dedup
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_pq_near_dedup": op9_pq_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op4_jaccard_join": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_lm_scoring": OP8_SQL,
    "op9_pq_near_dedup": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
