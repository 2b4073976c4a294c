"""The corpus queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import oracles
from schemaloom.llm.html_text import op8_html_text
from schemaloom.llm.jaccard_join import op4_jaccard_join
from schemaloom.llm.lattice import op9_lattice
from schemaloom.llm.lm import op7_lm
from schemaloom.llm.lz_fingerprint import op12_lz_fingerprint
from schemaloom.llm.packing import op3_packing
from schemaloom.llm.pii import op5_pii
from schemaloom.llm.quality_rules import op6_quality_rules
from schemaloom.llm.resample import op13_resample
from schemaloom.llm.sp_codec import op10_sentencepiece
from schemaloom.llm.spelling import op11_spelling
from schemaloom.llm.toxicity import op2_toxicity
from schemaloom.llm.url_rules import op1_url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm": op7_lm,
    "op8_html_text": op8_html_text,
    "op9_lattice": op9_lattice,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling": op11_spelling,
    "op12_lz_fingerprint": op12_lz_fingerprint,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_rules": oracles.URL_RULES,
    "op4_jaccard_join": oracles.JACCARD_JOIN,
    "op9_lattice": oracles.LATTICE,
    "op11_spelling": oracles.SPELLING,
    "op13_resample": oracles.RESAMPLE,
}
