"""The queries of the training-data operators and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinship.llm.byte_bpe import op2_byte_bpe
from kinship.llm.covertree import op5_covertree
from kinship.llm.hamming import OP3_SQL, op3_topk
from kinship.llm.jaccard import op7_jaccard
from kinship.llm.language import op6_language
from kinship.llm.licenses import op1_licenses
from kinship.llm.lines import op10_lines
from kinship.llm.packing import op8_packing
from kinship.llm.toxicity import op4_toxicity
from kinship.llm.urls import OP9_SQL, op9_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licenses": op1_licenses, "op2_byte_bpe": op2_byte_bpe, "op3_topk": op3_topk, "op4_toxicity": op4_toxicity, "op5_covertree": op5_covertree, "op6_language": op6_language, "op7_jaccard": op7_jaccard, "op8_packing": op8_packing, "op9_urls": op9_urls, "op10_lines": op10_lines}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op9_urls": OP9_SQL}
