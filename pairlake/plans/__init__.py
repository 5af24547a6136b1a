"""Named queries over the driver tables; importing this package fills the
registry."""

from pairlake.plans import q_batching, q_composed, q_derived, q_eval, q_files, q_latents, q_paths, q_stats  # noqa: F401
from pairlake.plans.registry import QUERIES, Query, register

__all__ = ["QUERIES", "Query", "register"]


def flagship(spark, sf_dir):
    return q_eval.evaluate_frame(spark, sf_dir)
