"""Imports every operator module so that its queries register."""

from flowlake.llm import (  # noqa: F401
    ann,
    bpe,
    chat_format,
    decontaminate,
    license_scan,
    mixing,
    near_dedup,
    quality,
    ranked_search,
    secret_scan,
    spelling,
    token_counts,
    warc,
)
from flowlake.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
