"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP13_SQL, op13_chat_format
from .decontamination import op2_decontamination
from .embedding_dups import OP5_SQL, op5_embedding_dups
from .lm_scores import op9_lm_scores
from .manifest import OP11_SQL, op11_merkle_manifest
from .near_dups import op10_near_duplicates
from .phrases import OP12_SQL, op12_phrases
from .quality import op1_quality
from .sentencepieces import op7_sentencepiece
from .sharding import op6_hilbert_shards
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op4_token_counts
from .warc import op3_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_decontamination,
        op3_warc_derivatives,
        op4_token_counts,
        op5_embedding_dups,
        op6_hilbert_shards,
        op7_sentencepiece,
        op8_suffix_dedup,
        op9_lm_scores,
        op10_near_duplicates,
        op11_merkle_manifest,
        op12_phrases,
        op13_chat_format,
    )
}

#: The others tokenise, train, sample or hash; tests/llm hold them against brute force, a library or an exact round trip.
ORACLE_SQL = {"op5_embedding_dups": OP5_SQL, "op11_merkle_manifest": OP11_SQL, "op12_phrases": OP12_SQL, "op13_chat_format": OP13_SQL}
