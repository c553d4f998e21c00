"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm import hard_negatives, line_dedup, near_dup, suffix_dedup
from tapeweave.llm.bpe_codec import op6_bpe_codec
from tapeweave.llm.cross_polytope import op1_cross_polytope
from tapeweave.llm.hard_negatives import op11_hard_negatives
from tapeweave.llm.line_dedup import op13_line_dedup
from tapeweave.llm.near_dup import op9_minhash_near_dedup
from tapeweave.llm.packing import op10_harmonic_packing
from tapeweave.llm.quality import op7_rule_quality
from tapeweave.llm.telephony import op4_telephony
from tapeweave.llm.suffix_tree_lm import op2_suffix_tree_lm
from tapeweave.llm.suffix_dedup import op3_suffix_dedup
from tapeweave.llm.token_alignment import op12_token_alignment
from tapeweave.llm.token_orc import op5_token_orc
from tapeweave.llm.toxicity import op8_bigru_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cross_polytope, op2_suffix_tree_lm, op3_suffix_dedup, op4_telephony, op5_token_orc, op6_bpe_codec, op7_rule_quality, op8_bigru_toxicity, op9_minhash_near_dedup, op10_harmonic_packing, op11_hard_negatives, op12_token_alignment, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """What SQL can express: learned models, tokenizers, approximate search and file formats it can't."""
    return {"op3_suffix_dedup": suffix_dedup.ORACLE_SQL, "op9_minhash_near_dedup": near_dup.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
