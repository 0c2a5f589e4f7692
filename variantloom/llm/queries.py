"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, html_text, mixing, ngram_join, packing, quality, secrets, token_rollups, vector_dedup, warc

QUERIES = {"op1_fingerprints": fingerprints.op1_fingerprints, "op2_warc": warc.op2_warc, "op3_quality": quality.op3_quality, "op4_packing": packing.op4_packing, "op5_secrets": secrets.op5_secrets, "op6_ngram_join": ngram_join.op6_ngram_join, "op7_vectors": vector_dedup.op7_vectors, "op8_html": html_text.op8_html, "op9_token_rollups": token_rollups.op9_token_rollups, "op10_mix": mixing.op10_mix}
ORACLE_SQL = {"op6_ngram_join": ngram_join.SQL, "op7_vectors": vector_dedup.SQL, "op2_warc": warc.SQL, "op10_mix": mixing.oracle()}
