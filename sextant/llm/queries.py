"""Queries of this subpackage: name -> callable(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from sextant.llm.bpe_codec import op10_bpe_codec
from sextant.llm.chat_format import op7_chat_tool_links
from sextant.llm.filter_audit import OP13_SQL, op13_filter_audit
from sextant.llm.fingerprints import op9_fingerprints
from sextant.llm.license_scan import op5_license_scan
from sextant.llm.media import op2_media_columns
from sextant.llm.minhash_dedup import op6_minhash_near_dedup
from sextant.llm.mixing import op4_mix_sources
from sextant.llm.quality import op1_quality_rules
from sextant.llm.quality_cascade import OP12_SQL, op12_rule_cascade
from sextant.llm.suffix_dedup import op3_suffix_dedup
from sextant.llm.toxicity import op8_toxicity
from sextant.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_license_scan": op5_license_scan,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_chat_tool_links": op7_chat_tool_links,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_rule_cascade": op12_rule_cascade,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op12_rule_cascade": OP12_SQL, "op13_filter_audit": OP13_SQL}
