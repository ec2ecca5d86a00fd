"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import ann_blocks, chunk_recipes, conversation_repair, lexical_search, license_scan, sentence_spans, source_mixing
from loomspan.llm.ann_blocks import op1_ann_blocks
from loomspan.llm.bpe_codec import op6_bpe
from loomspan.llm.chunk_recipes import op11_chunk_recipes
from loomspan.llm.common import table
from loomspan.llm.conversation_repair import op12_conversation_repair
from loomspan.llm.lexical_search import op13_lexical_search
from loomspan.llm.ogg_media import op7_ogg
from loomspan.llm.quality_knn import op5_quality
from loomspan.llm.sentence_spans import op10_sentence_spans
from loomspan.llm.separator_scan import op9_separator_scan
from loomspan.llm.simhash_trie import op8_simhash
from loomspan.llm.source_mixing import op4_mixing
from loomspan.llm.toxicity import op2_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_ann_blocks": lambda spark, sf_dir: op1_ann_blocks(table(spark, sf_dir, "embeddings")),
    "op2_toxicity": _with_labels(op2_toxicity),
    "op3_license_scan": _over_documents(license_scan.op3_license_scan),
    "op4_mixing": _over_documents(op4_mixing),
    "op5_quality": _with_labels(op5_quality),
    "op6_bpe": _over_documents(op6_bpe),
    "op7_ogg": _over_documents(op7_ogg),
    "op8_simhash": _over_documents(op8_simhash),
    "op9_separator_scan": _over_documents(op9_separator_scan),
    "op10_sentence_spans": _over_documents(op10_sentence_spans),
    "op11_chunk_recipes": _over_documents(op11_chunk_recipes),
    "op12_conversation_repair": lambda spark, sf_dir: op12_conversation_repair(table(spark, sf_dir, "conversations")),
    "op13_lexical_search": lambda spark, sf_dir: op13_lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

ORACLES: dict[str, str] = {
    "op1_ann_blocks": ann_blocks.oracle_sql(),
    "op3_license_scan": license_scan.oracle_sql(),
    "op4_mixing": source_mixing.oracle_sql(),
    "op10_sentence_spans": sentence_spans.oracle_sql(),
    "op11_chunk_recipes": chunk_recipes.oracle_sql(),
    "op12_conversation_repair": conversation_repair.oracle_sql(),
    "op13_lexical_search": lexical_search.oracle_sql(),
}
