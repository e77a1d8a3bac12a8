"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from helpgrid.llm.decontamination import op8_decontamination
from helpgrid.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from helpgrid.llm.line_dedup import OP1_SQL, op1_line_dedup
from helpgrid.llm.lm_scoring import op7_lm_scoring
from helpgrid.llm.mixing import op2_mixing
from helpgrid.llm.ngram_join import op4_ngram_join
from helpgrid.llm.packing import op12_packing
from helpgrid.llm.periodic_runs import op13_periodic_runs
from helpgrid.llm.pii import op5_pii
from helpgrid.llm.quality import op9_quality
from helpgrid.llm.ranked_search import OP11_SQL, op11_ranked_search
from helpgrid.llm.token_counts import op6_token_counts
from helpgrid.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_packing": op12_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op1_line_dedup": OP1_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
}
