"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from stratalens.llm.bpe_stream import op8_bpe_codec
from stratalens.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from stratalens.llm.language_id import op6_language_id
from stratalens.llm.line_dedup import OP4_SQL, op4_line_dedup
from stratalens.llm.packing import op3_best_fit_packing
from stratalens.llm.sharding import op10_sharding
from stratalens.llm.simhash_dedup import op5_simhash_dedup
from stratalens.llm.token_files import op9_token_files
from stratalens.llm.topk_search import OP1_SQL, op1_topk_search
from stratalens.llm.toxicity import op7_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_topk_search": op1_topk_search,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_token_files": op9_token_files,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {
    "op1_topk_search": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
}
