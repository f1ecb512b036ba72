"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from oriel.llm.ann import op9_ann
from oriel.llm.bpe import op1_bpe
from oriel.llm.convrepair import op11_conversations
from oriel.llm.decontam import op5_decontam
from oriel.llm.langid import op7_language
from oriel.llm.linededup import OP4_SQL, op4_line_dedup
from oriel.llm.neardup import op10_minhash
from oriel.llm.pii import op3_pii
from oriel.llm.quality import op2_quality
from oriel.llm.secrets import op6_secrets
from oriel.llm.sharding import op8_sharding
from oriel.llm.spelling import OP13_SQL, op13_spelling
from oriel.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontam": op5_decontam,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_sharding": op8_sharding,
    "op9_ann": op9_ann,
    "op10_minhash": op10_minhash,
    "op11_conversations": op11_conversations,
    "op12_toxicity": op12_toxicity,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op13_spelling": OP13_SQL,
}
