"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, crossparse, decontam, htmltext, langid, mixing, pii, quality, simhash, urlfilter

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_ann": ann.op3_ann,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_html": htmltext.op6_html,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_crossparse": crossparse.op9_crossparse,
    "op10_url_filter": urlfilter.op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
}
