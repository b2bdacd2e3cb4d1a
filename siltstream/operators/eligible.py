"""Records that cleaning neither removed nor set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstream.session import sized


def eligible(flows: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows of flows without a row in audit of the same source_file and source_row (null keys match nothing)."""
    return flows.join(sized(audit.select("source_file", "source_row").distinct()), ["source_file", "source_row"], "left_anti")
