"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from voxloom.llm import chat_format, decontam, licenses
from voxloom.llm.bpe import op2_bpe
from voxloom.llm.chat_format import op1_chat
from voxloom.llm.decontam import op8_decontam
from voxloom.llm.embedding_dedup import op3_embeddings
from voxloom.llm.licenses import op4_licenses
from voxloom.llm.ngram_lm import op6_lm
from voxloom.llm.quality import op7_quality
from voxloom.llm.simhash import op10_simhash
from voxloom.llm.suffix_dedup import op5_suffix
from voxloom.llm.url_filter import op9_urls

QUERIES = {
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_embeddings": op3_embeddings,
    "op4_licenses": op4_licenses,
    "op5_suffix": op5_suffix,
    "op6_lm": op6_lm,
    "op7_quality": op7_quality,
    "op8_decontam": op8_decontam,
    "op9_urls": op9_urls,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op1_chat": chat_format.ORACLE, "op4_licenses": licenses.ORACLE, "op8_decontam": decontam.ORACLE}
