"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_decontamination
from .embedding_dedup import op3_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .importance_resampling import OP13_SQL, op13_importance_resampling
from .jaccard_join import op6_jaccard_join
from .language import op10_language
from .lm_scoring import op4_lm_scoring
from .mixing import OP2_SQL, op2_mixing
from .quality import op9_quality
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .topk_search import OP12_SQL, op12_topk_search
from .warc import op7_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_topk_search": op12_topk_search,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_topk_search": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
