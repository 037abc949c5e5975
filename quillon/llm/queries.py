"""The ten operators' queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from .covertree import ORACLE as TOPK_SQL
from .covertree import op7_topk
from .ctw import op4_lm_scoring
from .fst import op9_sentencepiece
from .langid import op6_language_id
from .lshforest import ORACLE as NEAR_SQL
from .lshforest import op10_near_duplicates
from .media import op3_media
from .mixing import ORACLE as MIXING_SQL
from .mixing import op2_mixing
from .sharding import op1_sharding
from .tokencount import op8_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_media": op3_media,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_topk": op7_topk,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL = {
    "op2_mixing": MIXING_SQL,
    "op7_topk": TOPK_SQL,
    "op10_near_duplicates": NEAR_SQL,
}
