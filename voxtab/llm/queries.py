"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from voxtab.llm.bpe import op7_byte_bpe
from voxtab.llm.decontaminate import OP2_SQL, op2_decontaminate
from voxtab.llm.importance import OP13_SQL, op13_importance
from voxtab.llm.language import op1_language
from voxtab.llm.licenses import op5_licenses
from voxtab.llm.pii import op12_pii
from voxtab.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from voxtab.llm.secrets import op6_secrets
from voxtab.llm.simhash import op3_simhash
from voxtab.llm.spotsigs import op9_spotsigs
from voxtab.llm.suffix_dedup import op10_suffix_array
from voxtab.llm.toxicity import op8_toxicity
from voxtab.llm.warc import OP4_SQL, op4_warc

QUERIES = {q.__name__: q for q in (
    op1_language,
    op2_decontaminate,
    op3_simhash,
    op4_warc,
    op5_licenses,
    op6_secrets,
    op7_byte_bpe,
    op8_toxicity,
    op9_spotsigs,
    op10_suffix_array,
    op11_prefix_trie,
    op12_pii,
    op13_importance,
)}

ORACLE = {
    "op2_decontaminate": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_importance": OP13_SQL,
}
