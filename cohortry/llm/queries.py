"""The registered queries of the package and their SQL.

The operators without SQL (3, 6, 8, 12 and 13: an automaton, trained models, graphs, eigenvectors) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import chat, decontaminate, fim, licenses, neardup, ngram_join, packing, quality, token_counts, topk, url_filter, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _over(query: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: query(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def llm_queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": _over(decontaminate.leaks, "documents", "benchmark"),
        "op2_chat_format": _over(chat.chat_digests, "conversations"),
        "op3_token_counts": _over(token_counts.token_counts, "documents"),
        "op4_warc_archive": _over(warc.archived_pages, "pages"),
        "op5_exact_topk": _over(topk.top_k, "embeddings"),
        "op6_quality_classifier": _over(quality.quality_scores, "documents"),
        "op7_packing": _over(packing.pack, "documents"),
        "op8_ngram_jaccard_join": _over(ngram_join.jaccard_classes, "documents"),
        "op9_url_filter": _over(url_filter.judge_urls, "pages"),
        "op10_license_scan": _over(licenses.license_hits, "documents"),
        "op11_fill_in_middle": _over(fim.fim_digests, "documents"),
        "op12_whitening": _over(whitening.whitened_components, "embeddings"),
        "op13_embedding_near_dedup": _over(neardup.near_duplicates, "embeddings"),
    }


def llm_oracle() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op2_chat_format": chat.SQL,
        "op4_warc_archive": warc.SQL,
        "op5_exact_topk": topk.SQL,
        "op7_packing": packing.SQL,
        "op9_url_filter": url_filter.SQL,
        "op10_license_scan": licenses.SQL,
        "op11_fill_in_middle": fim.SQL,
    }
