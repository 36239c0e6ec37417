"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrowmill.llm import chat_format, exact_dedup, filter_audit, length_histogram, mixing, ngram_join, pieces, prefix_trie, quality_rules, secret_ledger, token_store, url_filter, warc

_MODULES = [token_store, ngram_join, url_filter, chat_format, quality_rules, length_histogram, mixing, pieces, warc, exact_dedup, prefix_trie, secret_ledger, filter_audit]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}
