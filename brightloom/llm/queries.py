"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from brightloom.llm.bpe import op3_bpe
from brightloom.llm.embeddings import op2_embeddings
from brightloom.llm.language import op10_language
from brightloom.llm.lm import op8_lm
from brightloom.llm.minhash import op7_minhash
from brightloom.llm.mixing import op1_mix
from brightloom.llm.neighbours import op6_neighbours
from brightloom.llm.oracles import SQL
from brightloom.llm.quality import op4_quality
from brightloom.llm.substrings import op9_substrings
from brightloom.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_mix": op1_mix,
    "op2_embeddings": op2_embeddings,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_neighbours": op6_neighbours,
    "op7_minhash": op7_minhash,
    "op8_lm": op8_lm,
    "op9_substrings": op9_substrings,
    "op10_language": op10_language,
}
ORACLE: dict[str, str] = dict(SQL)
