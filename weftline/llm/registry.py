"""The queries of the numbered problems, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content, copies, leaks, pairs, pieces, quality, splits, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": copies.p1_found,
        "p1_groups": copies.p1_groups,
        "p2_found": pairs.p2_found,
        "p2_labels": pairs.p2_labels,
        "p3_found": splits.p3_found,
        "p3_report": splits.p3_report,
        "p4_found": quality.p4_found,
        "p4_statistics": quality.p4_statistics,
        "p5_found": pieces.p5_found,
        "p5_pieces": pieces.p5_pieces,
        "p6_ids": tokens.p6_ids,
        "p7_found": leaks.p7_found,
        "p7_overlaps": leaks.p7_overlaps,
        "p8_found": content.p8_found,
        "p8_scores": content.p8_scores,
        "p8_rates": content.p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {"p5_found": pieces.P5_FOUND_SQL}
