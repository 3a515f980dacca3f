"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_mixing
from .near_dedup import OP3_SQL, op3_near_dedup
from .packing import op7_packing
from .quality_fm import op10_quality_fm
from .quality_rules import OP9_SQL, op9_quality_rules
from .token_rollups import op8_token_rollups
from .toxicity_chain import op2_toxicity_chain
from .vector_join import OP4_SQL, op4_vector_join
from .warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity_chain, op3_near_dedup, op4_vector_join, op5_mixing, op6_line_dedup, op7_packing, op8_token_rollups, op9_quality_rules, op10_quality_fm)}
SQL = {"op1_warc": OP1_SQL, "op3_near_dedup": OP3_SQL, "op4_vector_join": OP4_SQL, "op5_mixing": OP5_SQL, "op6_line_dedup": OP6_SQL, "op9_quality_rules": OP9_SQL}
