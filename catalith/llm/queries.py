"""The queries of the llm operators and their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, exact_dedup, katz, langid, licenses, packing, quality, simhash, toxicity, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_katz": katz.op3_katz,
    "op4_simhash": simhash.op4_simhash,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_licenses": licenses.op10_licenses,
}

SQL = {**exact_dedup.SQL, **packing.SQL, **warc.SQL}
