"""The queries opN_<name> and their SQL, for __spark_entry__."""

from __future__ import annotations

from .alignment import op12_align
from .decontaminate import OP5_SQL, op5_decontaminate
from .embeddings import OP4_SQL, op4_near_vectors
from .lm_scoring import op11_lm_score
from .mixing import OP8_SQL, op8_mix
from .ngram_join import OP6_SQL, op6_ngram_join
from .quality import op10_quality
from .resampling import OP13_SQL, op13_resample
from .secrets import OP2_SQL, op2_secrets
from .sharding import OP1_SQL, op1_shards
from .suffix_array import OP9_SQL, op9_bytes
from .suffix_tree import OP7_SQL, op7_substrings
from .toxicity import op3_toxicity

QUERIES = {
    "op1_shards": op1_shards,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_near_vectors": op4_near_vectors,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_join": op6_ngram_join,
    "op7_substrings": op7_substrings,
    "op8_mix": op8_mix,
    "op9_bytes": op9_bytes,
    "op10_quality": op10_quality,
    "op11_lm_score": op11_lm_score,
    "op12_align": op12_align,
    "op13_resample": op13_resample,
}
SQL = {
    "op1_shards": OP1_SQL,
    "op2_secrets": OP2_SQL,
    "op4_near_vectors": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_ngram_join": OP6_SQL,
    "op7_substrings": OP7_SQL,
    "op8_mix": OP8_SQL,
    "op9_bytes": OP9_SQL,
    "op13_resample": OP13_SQL,
}
