"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .htmltext import op4_html
from .iblt import op2_fingerprints
from .linededup import OP5_SQL, op5_line_dedup
from .packing import op6_packing
from .pieces import op3_pieces
from .quality import op8_quality
from .sharding import OP12_SQL, op12_sharding
from .simhash import op1_simhash
from .sortmeans import OP13_SQL, op13_sortmeans
from .substring import op9_substring
from .topk import OP10_SQL, op10_topk
from .toxicity import op7_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_pieces": op3_pieces,
    "op4_html": op4_html,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_substring": op9_substring,
    "op10_topk": op10_topk,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_sortmeans": op13_sortmeans,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op10_topk": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_sharding": OP12_SQL,
    "op13_sortmeans": OP13_SQL,
}
