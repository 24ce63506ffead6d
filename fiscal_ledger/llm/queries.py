"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from fiscal_ledger.llm.bpe import op7_bpe
from fiscal_ledger.llm.embeddings import op3_embeddings
from fiscal_ledger.llm.fingerprints import op1_fingerprints
from fiscal_ledger.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from fiscal_ledger.llm.html_text import op9_html_text
from fiscal_ledger.llm.mixing import OP10_SQL, op10_mixing
from fiscal_ledger.llm.near_duplicates import op6_near_duplicates
from fiscal_ledger.llm.prefix_trie import OP12_SQL, op12_trie
from fiscal_ledger.llm.quality import op8_quality
from fiscal_ledger.llm.repeats import op4_repeats
from fiscal_ledger.llm.token_counts import op5_token_counts
from fiscal_ledger.llm.warc import OP2_SQL, op2_warc
from fiscal_ledger.llm.wavelet import op11_wavelet


def queries():
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_warc": op2_warc,
        "op3_embeddings": op3_embeddings,
        "op4_repeats": op4_repeats,
        "op5_token_counts": op5_token_counts,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_bpe": op7_bpe,
        "op8_quality": op8_quality,
        "op9_html_text": op9_html_text,
        "op10_mixing": op10_mixing,
        "op11_wavelet": op11_wavelet,
        "op12_trie": op12_trie,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op10_mixing": OP10_SQL, "op12_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
