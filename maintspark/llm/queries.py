"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from . import divergence
from .common import read
from .decontaminate import op8_decontamination
from .html_text import op3_html_text
from .jaccard_join import op6_jaccard_join
from .media import op4_media
from .mixing import op10_mixing
from .pii import op1_pii
from .quality import op9_quality
from .secret_scan import op7_secret_scan
from .sharding import op13_sharding
from .substring_dedup import op5_substring_dedup
from .token_store import op2_token_store
from .whitening import op11_whitening

QUERIES = {
    "op1_pii": lambda spark, d: op1_pii(read(spark, d, "documents")),
    "op2_token_store": lambda spark, d: op2_token_store(spark, read(spark, d, "documents")),
    "op3_html_text": lambda spark, d: op3_html_text(read(spark, d, "pages")),
    "op4_media": lambda spark, d: op4_media(read(spark, d, "documents")),
    "op5_substring_dedup": lambda spark, d: op5_substring_dedup(read(spark, d, "documents")),
    "op6_jaccard_join": lambda spark, d: op6_jaccard_join(read(spark, d, "documents")),
    "op7_secret_scan": lambda spark, d: op7_secret_scan(read(spark, d, "documents")),
    "op9_quality": lambda spark, d: op9_quality(read(spark, d, "documents"), read(spark, d, "labels")),
    "op8_decontamination": lambda spark, d: op8_decontamination(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op10_mixing": lambda spark, d: op10_mixing(spark, read(spark, d, "documents")),
    "op11_whitening": lambda spark, d: op11_whitening(read(spark, d, "embeddings")),
    "op12_divergence": lambda spark, d: divergence.op12_divergence(read(spark, d, "documents")),
    "op13_sharding": lambda spark, d: op13_sharding(read(spark, d, "documents")),
}
ORACLE_SQL: dict[str, str] = {"op12_divergence": divergence.ORACLE}
