"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from basketforge.llm.decontaminate import OP6_SQL, op6_decontaminate
from basketforge.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from basketforge.llm.language_id import op3_language
from basketforge.llm.line_dedup import op8_line_dedup
from basketforge.llm.packing import op10_pack
from basketforge.llm.quality import op1_quality
from basketforge.llm.secret_scan import op5_secrets
from basketforge.llm.shingle_join import op2_jaccard_join
from basketforge.llm.token_store import op4_token_store
from basketforge.llm.toxicity import op13_toxicity
from basketforge.llm.url_trust import op9_url_trust
from basketforge.llm.vector_dedup import op7_vector_dedup
from basketforge.llm.word_runs import op12_word_runs

QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language": op3_language,
    "op4_token_store": op4_token_store,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_trust": op9_url_trust,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_word_runs": op12_word_runs,
    "op13_toxicity": op13_toxicity,
}
SQL = {"op6_decontaminate": OP6_SQL, "op11_hard_negatives": OP11_SQL}
