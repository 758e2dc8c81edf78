"""The registered queries of this subpackage, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from .bpe_codec import op6_bpe_codec
from .context_tree import op11_context_tree
from .digests import op3_digests
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_text import op7_html_text
from .mixing import op9_mixing
from .ngram_join import op5_ngram_join
from .spelling import OP12_SQL, op12_spelling
from .substring_dedup import op10_substring_dedup
from .token_counts import op8_token_counts
from .topk import OP2_SQL, op2_topk
from .toxicity import op1_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op7_html_text": op7_html_text,
    "op9_mixing": op9_mixing,
    "op4_warc": op4_warc,
    "op2_topk": op2_topk,
    "op5_ngram_join": op5_ngram_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op1_toxicity": op1_toxicity,
    "op3_digests": op3_digests,
    "op6_bpe_codec": op6_bpe_codec,
    "op8_token_counts": op8_token_counts,
    "op11_context_tree": op11_context_tree,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op2_topk": OP2_SQL, "op4_warc": OP4_SQL, "op12_spelling": OP12_SQL, "op13_hard_negatives": OP13_SQL}
