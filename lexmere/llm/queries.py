"""The queries of this subpackage and the SQL that their results are held against."""

from __future__ import annotations

from lexmere.llm import context_tree, cross_polytope, exact_dedup, filter_audit, id_store, language_id, lexicon, mixing, packing, resampling, simhash, url_filter, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_mixing": mixing.op2_mixing,
    "op3_context_tree": context_tree.op3_context_tree,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_id_store": id_store.op6_id_store,
    "op7_best_two_fit": packing.op7_best_two_fit,
    "op8_cross_polytope": cross_polytope.op8_cross_polytope,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bpe_lexicon": lexicon.op12_bpe_lexicon,
    "op13_resampling": resampling.op13_resampling,
}
ORACLE_SQL = {
    "op1_warc_revisits": warc.OP1_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
