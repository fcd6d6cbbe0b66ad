"""The queries of this subpackage: one for each operator, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, langid, licences, line_templates, media, neighbours, packing, simhash, token_counts, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.query,
    "op2_packing": packing.query,
    "op3_token_files": token_files.query,
    "op4_licences": licences.query,
    "op5_langid": langid.query,
    "op6_bpe": bpe.query,
    "op7_line_templates": line_templates.query,
    "op8_simhash": simhash.query,
    "op9_token_counts": token_counts.query,
    "op10_neighbours": neighbours.query,
}
ORACLES: dict[str, str] = {"op7_line_templates": line_templates.ORACLE}
