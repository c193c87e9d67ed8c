"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op13_byte_bpe
from .decontaminate import OP6_SQL, op6_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_extract import op2_html_extract
from .lm_score import OP8_SQL, op8_lm_score
from .mixing import op4_mixing
from .quality import op5_quality
from .secrets import op3_secrets
from .simhash import op10_simhash_dedup
from .spelling import op12_spelling
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .toxicity import op1_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extract": op2_html_extract,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL = {
    "op6_decontaminate": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_lm_score": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
}
