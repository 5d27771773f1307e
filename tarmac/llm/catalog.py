"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import (decontaminate, exact_dedup, filter_audit, jaccard_join, lexical_search, mixing, sharding,
                        substring_dedup, suffix_dedup, warc)
from tarmac.llm.common import table
from tarmac.llm.decontaminate import op6_decontaminate
from tarmac.llm.exact_dedup import op7_exact_dedup
from tarmac.llm.filter_audit import op13_filter_audit
from tarmac.llm.jaccard_join import op11_jaccard_join
from tarmac.llm.lexical_search import op12_lexical_search
from tarmac.llm.mixing import op2_mix_sources
from tarmac.llm.near_dedup import op1_dart_minhash
from tarmac.llm.sharding import op5_shard, op5_shard_fine
from tarmac.llm.substring_dedup import op3_substring_dedup, op3_substring_dedup_grown
from tarmac.llm.suffix_dedup import op4_suffix_dedup
from tarmac.llm.token_counts import op8_token_counts
from tarmac.llm.toxicity import op10_toxicity
from tarmac.llm.warc import op9_warc


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[table(spark, sf_dir, t) for t in tables])
    query.__name__ = operator.__name__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": _over(op1_dart_minhash, "documents"),
    "op2_mix_sources": _over(op2_mix_sources, "documents"),
    "op3_substring_dedup": _over(op3_substring_dedup, "documents"),
    "op3_substring_dedup_grown": _over(op3_substring_dedup_grown, "documents"),
    "op4_suffix_dedup": _over(op4_suffix_dedup, "documents"),
    "op5_shard": _over(op5_shard, "documents"),
    "op5_shard_fine": _over(op5_shard_fine, "documents"),
    "op6_decontaminate": _over(op6_decontaminate, "documents", "benchmark"),
    "op7_exact_dedup": _over(op7_exact_dedup, "documents"),
    "op8_token_counts": _over(op8_token_counts, "documents"),
    "op9_warc": _over(op9_warc, "pages"),
    "op10_toxicity": _over(op10_toxicity, "documents", "labels"),
    "op11_jaccard_join": _over(op11_jaccard_join, "documents"),
    "op12_lexical_search": _over(op12_lexical_search, "documents", "benchmark"),
    "op13_filter_audit": _over(op13_filter_audit, "documents", "labels"),
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op5_shard": sharding.ORACLE,
    "op5_shard_fine": sharding.ORACLE_FINE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_jaccard_join": jaccard_join.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
