"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from braidwork.llm import ctph, decontaminate, hamerly, html, langid, lines, minhash, mixing, partenum, spelling, tokens, toxicity, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_fingerprints": ctph.op2_fingerprints,
    "op3_minhash": minhash.op3_minhash,
    "op4_langid": langid.op4_langid,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lines": lines.op6_lines,
    "op7_mixing": mixing.op7_mixing,
    "op8_tokens": tokens.op8_tokens,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_clusters": hamerly.op12_clusters,
    "op13_partenum": partenum.op13_partenum,
}

ORACLE_SQL = {
    "op3_minhash": minhash.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_lines": lines.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_clusters": hamerly.OP12_SQL,
    "op13_partenum": partenum.OP13_SQL,
}
