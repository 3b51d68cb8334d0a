"""The registered queries of the text operators and the SQL that states the same results."""

from __future__ import annotations

import corpus_pipeline
from caselens.llm.ann import op2_ann
from caselens.llm.bpe import op5_bpe
from caselens.llm.decontaminate import OP8_SQL, op8_decontaminate
from caselens.llm.language import op6_language_id
from caselens.llm.line_dedup import op3_line_dedup
from caselens.llm.lm_score import OP10_BACKOFF_SQL, OP10_CUTOFF_SQL, OP10_SQL, op10_lm_score, op10_lm_score_backoff, op10_lm_score_cutoff
from caselens.llm.merkle import OP11_SQL, op11_merkle
from caselens.llm.mixing import OP13_SQL, op13_mixing
from caselens.llm.near_dedup import OP1_SQL, op1_near_dedup
from caselens.llm.quality import op9_quality
from caselens.llm.repeats import OP12_SQL, op12_periodic_runs
from caselens.llm.sharding import op7_sharding
from caselens.llm.token_counts import op4_token_counts

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_ann": op2_ann,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_lm_score": op10_lm_score,
    "op10_lm_score_backoff": op10_lm_score_backoff,
    "op10_lm_score_cutoff": op10_lm_score_cutoff,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_near_dedup": OP1_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_lm_score": OP10_SQL,
    "op10_lm_score_backoff": OP10_BACKOFF_SQL,
    "op10_lm_score_cutoff": OP10_CUTOFF_SQL,
    "op11_merkle": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_mixing": OP13_SQL,
}
