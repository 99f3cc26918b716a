"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing
from .decontamination import op7_decontamination
from .exact_dedup import op6_exact_dedup
from .html_extraction import op3_html_extraction
from .line_dedup import op4_line_dedup
from .mixing import op5_mixing
from .near_dedup import op10_near_dedup
from .quality_classifier import op2_quality_classifier
from .substring_dedup import op1_substring_dedup
from .token_counts import op8_token_counts
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality_classifier, op3_html_extraction, op4_line_dedup, op5_mixing,
        op6_exact_dedup, op7_decontamination, op8_token_counts, op9_warc, op10_near_dedup,
    )
}

ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
