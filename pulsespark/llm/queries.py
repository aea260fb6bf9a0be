"""Queries of the training-data operators, for the entry module: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsespark.llm import op11_trie, op13_variants
from pulsespark.llm.op1_suffix import op1_suffix
from pulsespark.llm.op2_quality import op2_quality
from pulsespark.llm.op3_language import op3_language
from pulsespark.llm.op4_html import op4_html
from pulsespark.llm.op5_mixing import op5_mixing
from pulsespark.llm.op6_gif import op6_gif
from pulsespark.llm.op7_windows import op7_windows
from pulsespark.llm.op8_bitpack import op8_bitpack
from pulsespark.llm.op9_bm25 import op9_bm25
from pulsespark.llm.op10_superminhash import op10_superminhash
from pulsespark.llm.op12_pieces import op12_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": op1_suffix,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_html": op4_html,
    "op5_mixing": op5_mixing,
    "op6_gif": op6_gif,
    "op7_windows": op7_windows,
    "op8_bitpack": op8_bitpack,
    "op9_bm25": op9_bm25,
    "op10_superminhash": op10_superminhash,
    "op11_trie": op11_trie.op11_trie,
    "op12_pieces": op12_pieces,
    "op13_variants": op13_variants.op13_variants,
}

#: SQL where it can express the operator. Models, schedules, codecs and approximate searches are held against
#: brute-force versions in tests/llm instead.
ORACLE_SQL: dict[str, str] = {"op11_trie": op11_trie.SQL, "op13_variants": op13_variants.SQL}
