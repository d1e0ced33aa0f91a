"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tagsim.llm.cover_tree import OP1_SQL, op1_cover_tree
from tagsim.llm.html_text import op13_html_text
from tagsim.llm.line_dedup import OP9_SQL, op9_line_dedup
from tagsim.llm.mixing import op10_mix_sources
from tagsim.llm.packing import op5_pack
from tagsim.llm.quality_rules import OP3_SQL, op3_quality_rules
from tagsim.llm.simhash import op2_simhash
from tagsim.llm.spelling import OP12_SQL, op12_spelling
from tagsim.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from tagsim.llm.token_counts import op7_token_counts
from tagsim.llm.token_files import op4_token_files
from tagsim.llm.url_filter import OP6_SQL, op6_url_filter
from tagsim.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_pack": op5_pack,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling": op12_spelling,
    "op13_html_text": op13_html_text,
}
ORACLES = {"op1_cover_tree": OP1_SQL, "op3_quality_rules": OP3_SQL, "op6_url_filter": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling": OP12_SQL}
