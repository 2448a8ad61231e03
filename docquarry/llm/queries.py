"""Registered queries of the ten operators and the pipeline; QUERIES and ORACLE_SQL by name."""

from __future__ import annotations

from .ann import op2_nearest_neighbours
from .decontam import OP6_SQL, op6_decontamination
from .neardup import OP9_SQL, op9_near_dedup
from .pieces import op1_sentencepiece
from .pitmanyor import BASE_UNIGRAMS_SQL, base_unigrams, op5_lm_scoring
from .secrets import BASE_SECRETS_SQL, base_secrets, op4_secret_scans
from .tokencount import op3_token_counts
from .toolcalls import OP8_SQL, op8_tool_calls
from .toxicity import op10_toxicity
from .warc import OP7_SQL, op7_warc_bundles

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scans": op4_secret_scans,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_tool_calls": op8_tool_calls,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
    # the columns of op4 and op5 that SQL can say, from the same operators
    "base_secrets": base_secrets,
    "base_unigrams": base_unigrams,
}

#: Lattices, trees, samplers and classifiers can't be said in SQL; their queries are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": OP6_SQL,
    "op7_warc_bundles": OP7_SQL,
    "op8_tool_calls": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "base_secrets": BASE_SECRETS_SQL,
    "base_unigrams": BASE_UNIGRAMS_SQL,
}
