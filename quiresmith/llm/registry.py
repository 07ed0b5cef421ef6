"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .decontamination import op8_cgk_decontamination
from .embedding_dedup import OP3_SQL, op3_subspace_pigeonhole
from .language_id import op7_language_id
from .ngram_join import op10_ngram_jaccard
from .pii import op1_weak_supervision_pii
from .sharding import op2_minimax_sharding
from .substring_dedup import OP6_SQL, op6_repeated_windows
from .suffix_dedup import op4_suffix_array_dedup
from .token_store import op9_token_store

QUERIES = {
    "op1_weak_supervision_pii": op1_weak_supervision_pii,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_subspace_pigeonhole": op3_subspace_pigeonhole,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_repeated_windows": op6_repeated_windows,
    "op7_language_id": op7_language_id,
    "op8_cgk_decontamination": op8_cgk_decontamination,
    "op9_token_store": op9_token_store,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLES: dict[str, str] = {
    "op3_subspace_pigeonhole": OP3_SQL,
    "op6_repeated_windows": OP6_SQL,
}
