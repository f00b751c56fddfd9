"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from foliant.llm import bpe, centroids, change_points, chat_format, jaccard_join, language_id, near_vectors, packing, personal_data, sharding, substring_dedup, topk, url_filter
from foliant.session import ship


def _shipped(f):
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    query.__name__, query.__doc__ = f.__name__, f.__doc__
    return query


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        topk.op1_topk,
        bpe.op2_bpe,
        jaccard_join.op3_jaccard_join,
        url_filter.op4_url_filter,
        near_vectors.op5_near_vectors,
        substring_dedup.op6_substring_dedup,
        language_id.op7_language_id,
        packing.op8_packing,
        chat_format.op9_chat_format,
        sharding.op10_sharding,
        personal_data.op11_personal_data,
        change_points.op12_change_points,
        centroids.op13_centroids,
    )
}
ORACLES = {"op1_topk": topk.OP1_SQL, "op9_chat_format": chat_format.OP9_SQL, "op12_change_points": change_points.OP12_SQL, "op13_centroids": centroids.OP13_SQL}
