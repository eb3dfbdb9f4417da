"""The operators' queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, forest, kneser, licenses, minhash, mixing, sharding, toxicity, urls, warc


def queries() -> dict:
    fns = (
        warc.op1_warc_chunks,
        urls.op4_redirect_equivalence,
        urls.redirects_over_pages,
        kneser.op2_kneser_ney_quality,
        decontam.op3_pigeonhole_leaks,
        forest.op5_projection_forest,
        sharding.op6_interleaved_shards,
        toxicity.op7_toxicity_cnn,
        mixing.op8_curriculum_mix,
        licenses.op9_license_compression,
        minhash.op10_lsh_forest,
    )
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_chunks": warc.ORACLE,
        "op4_redirect_equivalence": urls.ORACLE,
        "redirects_over_pages": urls.REDIRECTS_ORACLE,
        "op5_projection_forest": forest.ORACLE,
        "op6_interleaved_shards": sharding.ORACLE,
        "op8_curriculum_mix": mixing.ORACLE,
        "op10_lsh_forest": minhash.ORACLE,
    }
