"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_spans import op2_dedup_byte_spans
from .embedding_dedup import op3_embedding_dedup
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op9_html_extract
from .license_scan import op1_license_scan
from .mixing import op8_mix_sources
from .oracles import OP2_SQL, OP3_SQL, OP4_SQL, OP6_SQL
from .packing import op5_pack_sequences
from .quality import op7_quality_classifier
from .shingle_join import op4_jaccard_join
from .word_spans import op6_dedup_word_spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan,
        op2_dedup_byte_spans,
        op3_embedding_dedup,
        op4_jaccard_join,
        op5_pack_sequences,
        op6_dedup_word_spans,
        op7_quality_classifier,
        op8_mix_sources,
        op9_html_extract,
        op10_exact_dedup,
    )
}

SQL: dict[str, str] = {"op2_dedup_byte_spans": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op6_dedup_word_spans": OP6_SQL, "op10_exact_dedup": OP10_SQL}
