"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from verbaline.llm import bpe, language_id, lm_score, metric_join, mixing, nn_descent, packing, quality, secrets, sharding, simhash, spelling, whitening


def queries():
    return {
        "op1_quality": quality.op1,
        "op2_lm_score": lm_score.op2,
        "op3_best_fit_packing": packing.op3,
        "op4_language_id": language_id.op4,
        "op5_metric_join": metric_join.op5,
        "op6_simhash": simhash.op6,
        "op7_nn_descent": nn_descent.op7,
        "op8_secrets": secrets.op8,
        "op9_mixing": mixing.op9,
        "op10_sharding": sharding.op10,
        "op11_bpe": bpe.op11,
        "op12_spelling": spelling.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql():
    """Models, tokenizers, fingerprints and offsets of matches are beyond SQL; those queries are tested against plain versions."""
    return {"op5_metric_join": metric_join.OP5_SQL, "op9_mixing": mixing.OP9_SQL, "op10_sharding": sharding.OP10_SQL, "op12_spelling": spelling.OP12_SQL}
