"""All registered queries (imported for their side effect on REGISTRY)."""
from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir, ship_package
from . import q_bayes_mlp, q_core, q_features, q_models, q_rules, q_stages, q_text  # noqa: F401
from .registry import REGISTRY


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, and the runtime SQL defaults (AQE, skew-join
    splitting, UTC) on a session built elsewhere — only where not set."""
    from ..session import DEFAULTS
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for k, v in DEFAULTS.items():
        if k.startswith("spark.sql.") and not k.startswith("spark.sql.files.") and k not in _explicit(spark):
            try:
                spark.conf.set(k, v)
            except Exception:  # static or locked settings stay as they are
                pass


def _explicit(spark: SparkSession) -> set[str]:
    try:
        return {k for k, _ in spark.sparkContext.getConf().getAll()}
    except Exception:
        return set()


def builders():
    def wrap(q):
        def run(spark, sf_dir):
            prepare(spark)
            return q.build(spark, sf_dir)
        run.__name__ = q.name
        return run
    return {n: wrap(q) for n, q in REGISTRY.items()}


def oracles():
    return {n: q.sql.strip() for n, q in REGISTRY.items() if q.sql}
