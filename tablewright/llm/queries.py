"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from tablewright.llm import ann, decontaminate, html_text, jaccard_join, langid, licences, mixing, quality, repeated_bytes, sentence_spans

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mixing": mixing.op3_mixing,
    "op4_repeated_bytes": repeated_bytes.op4_repeated_bytes,
    "op5_licences": licences.op5_licences,
    "op6_quality": quality.op6_quality,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_langid": langid.op8_langid,
    "op9_html": html_text.op9_html,
    "op10_sentence_spans": sentence_spans.op10_sentence_spans,
}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_repeated_bytes": repeated_bytes.OP4_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op10_sentence_spans": sentence_spans.OP10_SQL,
}
