"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from framewright.llm import ann, byte_bpe, decontaminate, html_extract, langid, lm, minhash, suffix, toxicity, warc

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_prob_minhash": minhash.op2_prob_minhash,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_lm": lm.op5_lm,
    "op6_suffix_array": suffix.op6_suffix_array,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc": warc.op8_warc,
    "op9_ann": ann.op9_ann,
    "op10_langid": langid.op10_langid,
}

SQL: dict[str, str] = {
    "op8_warc": warc.OP8_SQL,
}
