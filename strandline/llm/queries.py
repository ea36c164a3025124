"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.language_id import op2_language_id
from strandline.llm.license_scan import op3_license_scan
from strandline.llm.media import op6_media_columns
from strandline.llm.minhash_dedup import op10_near_duplicates
from strandline.llm.mixing import op1_mix_sources
from strandline.llm.packing import op4_packing
from strandline.llm.substring_dedup import op7_substring_dedup
from strandline.llm.suffix_dedup import op8_suffix_array_dedup
from strandline.llm.topk_search import op5_topk_search
from strandline.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_id,
        op3_license_scan,
        op4_packing,
        op5_topk_search,
        op6_media_columns,
        op7_substring_dedup,
        op8_suffix_array_dedup,
        op9_url_filter,
        op10_near_duplicates,
    )
}
SQL: dict[str, str] = {"op9_url_filter": OP9_SQL}
