"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_format
from .forest import OP6_SQL, op6_near_vectors
from .langid import op7_language
from .mtree import OP3_SQL, op3_top_k
from .negatives import OP12_SQL, op12_hard_negatives
from .ngram_join import OP1_SQL, op1_ngram_jaccard
from .packing import op10_pack
from .pii import op8_pii
from .quality import op11_quality
from .resample import OP13_SQL, op13_resample
from .tokenfile import op9_token_files
from .tokenize import op5_bpe
from .warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_chat_format": op2_chat_format,
        "op3_top_k": op3_top_k,
        "op4_warc": op4_warc,
        "op5_bpe": op5_bpe,
        "op6_near_vectors": op6_near_vectors,
        "op7_language": op7_language,
        "op8_pii": op8_pii,
        "op9_token_files": op9_token_files,
        "op10_pack": op10_pack,
        "op11_quality": op11_quality,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_top_k": OP3_SQL, "op4_warc": OP4_SQL, "op6_near_vectors": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_resample": OP13_SQL}
