"""The corpus operators' queries, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import _common as C
from . import ann, bpe, html_extract, langid, line_dedup, lm_score, minhash, mixing, quality_model, quality_rules, runs, substring_dedup, whitening

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_ann": ann.op2_ann,
    "op3_quality": quality_model.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_langid": langid.op9_langid,
    "op10_minhash": minhash.op10_minhash,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_lm_score": lm_score.op13_lm_score,
}

QUERIES = {name: C.shipped(query) for name, query in QUERIES.items()}

ORACLE = {
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op10_minhash": minhash.ORACLE,
}
