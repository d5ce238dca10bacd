"""Query routing by weighted patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import lexicon as lx


def route_query(c, computational=lx.COMPUTATIONAL, factual=lx.FACTUAL, computational_threshold: float = 0.6, factual_threshold: float = 0.5) -> Column:
    """struct<intent, confidence, processing_path, filter_chunk_types, matched_patterns>."""
    q = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))

    def scored(rules):
        best = F.greatest(F.lit(0.0), *[F.when(q.rlike("(?U)" + p), w).otherwise(0.0) for p, w in rules])
        return best, F.array_compact(F.array(*[F.when(q.rlike("(?U)" + p), F.lit(p)) for p, _ in rules]))

    (comp, comp_hit), (fact, fact_hit) = scored(computational), scored(factual)
    is_comp = (comp >= computational_threshold) & (comp > fact)
    is_fact = fact >= factual_threshold
    return F.struct(
        F.when(is_comp, "computational").when(is_fact, "factual").otherwise("unknown").alias("intent"),
        F.when(is_comp, comp).when(is_fact, fact).otherwise(F.greatest(comp, fact)).alias("confidence"),
        F.when(is_comp, "computational").otherwise("retrieval").alias("processing_path"),
        F.when(is_comp, F.array(F.lit("table"))).otherwise(F.array(F.lit("text"), F.lit("table"))).alias("filter_chunk_types"),
        F.when(is_comp, comp_hit).when(is_fact, fact_hit).otherwise(F.concat(comp_hit, fact_hit)).alias("matched_patterns"),
    )
