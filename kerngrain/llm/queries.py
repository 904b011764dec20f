"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13

QUERIES = {
    "op1_warc_revisits": op01.op1_warc_revisits,
    "op2_toxicity": op02.op2_toxicity,
    "op3_quality_fertility": op03.op3_quality_fertility,
    "op4_mixture_packing": op04.op4_mixture_packing,
    "op5_language_id": op05.op5_language_id,
    "op6_licence_digests": op06.op6_licence_digests,
    "op7_chunked_bpe": op07.op7_chunked_bpe,
    "op8_wrapper_extraction": op08.op8_wrapper_extraction,
    "op9_binary_code_search": op09.op9_binary_code_search,
    "op10_minhash_near_dedup": op10.op10_minhash_near_dedup,
    "op11_credential_links": op11.op11_credential_links,
    "op12_importance_resampling": op12.op12_importance_resampling,
    "op13_fill_in_middle": op13.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_warc_revisits": op01.ORACLE_SQL,
    "op6_licence_digests": op06.ORACLE_SQL,
    "op9_binary_code_search": op09.ORACLE_SQL,
    "op10_minhash_near_dedup": op10.ORACLE_SQL,
    "op11_credential_links": op11.ORACLE_SQL,
    "op12_importance_resampling": op12.ORACLE_SQL,
    "op13_fill_in_middle": op13.ORACLE_SQL,
}
