"""Registered queries of this folder, each over its whole tables, with SQL where SQL can express it."""

from lexmill.llm.chat import OP7_SQL, op7_chat_formatting
from lexmill.llm.collocations import OP12_SQL, op12_collocations
from lexmill.llm.html import op3_html_extraction
from lexmill.llm.jaccard_join import op9_jaccard_join
from lexmill.llm.mixing import OP8_SQL, op8_mixing
from lexmill.llm.pieces import op4_sentencepiece
from lexmill.llm.quality import op5_quality_rules
from lexmill.llm.secrets import op13_secret_scan
from lexmill.llm.suffix_dedup import op2_suffix_dedup
from lexmill.llm.token_files import op6_token_files
from lexmill.llm.topk import OP1_SQL, op1_top_k
from lexmill.llm.urls import OP10_SQL, op10_url_filter
from lexmill.llm.whitening import op11_whitening

#: name -> (function of (spark, sf_dir), SQL or None)
QUERIES = {
    "op1_top_k": (op1_top_k, OP1_SQL),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_html_extraction": (op3_html_extraction, None),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_token_files": (op6_token_files, None),
    "op7_chat_formatting": (op7_chat_formatting, OP7_SQL),
    "op8_mixing": (op8_mixing, OP8_SQL),
    "op9_jaccard_join": (op9_jaccard_join, None),
    "op10_url_filter": (op10_url_filter, OP10_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_secret_scan": (op13_secret_scan, None),
}
