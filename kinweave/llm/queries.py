"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from kinweave.llm.bpe import op2_bpe
from kinweave.llm.chat import OP3_SQL, op3_chat
from kinweave.llm.embeddings import OP1_SQL, op1_embeddings
from kinweave.llm.licenses import op11_licenses
from kinweave.llm.lines import OP4_PASSAGES_SQL, OP4_SQL, op4_lines, op4_passages
from kinweave.llm.mixing import OP5_SQL, op5_mixing
from kinweave.llm.simhash import op10_simhash
from kinweave.llm.spotsigs import op9_groups, op9_spotsigs
from kinweave.llm.suffixes import op8_suffixes
from kinweave.llm.toxicity import op7_toxicity
from kinweave.llm.warc import OP6_SQL, op6_warc
from kinweave.llm.whitening import op12_whitening

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_lines": op4_lines,
    "op4_passages": op4_passages,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_suffixes": op8_suffixes,
    "op9_spotsigs": op9_spotsigs,
    "op9_groups": op9_groups,
    "op10_simhash": op10_simhash,
    "op11_licenses": op11_licenses,
    "op12_whitening": op12_whitening,
}

SQL: dict[str, str] = {
    "op1_embeddings": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op4_lines": OP4_SQL,
    "op4_passages": OP4_PASSAGES_SQL,
    "op5_mixing": OP5_SQL,
    "op6_warc": OP6_SQL,
}
