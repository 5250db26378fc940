"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexweave.llm import exact_dedup, html_density, media, packing, pieces, quality, secret_scan, sharding, simhash, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_html": html_density.op6_html,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_packing": packing.op9_packing,
    "op10_warc": warc.op10_warc,
}
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op10_warc": warc.ORACLE}
