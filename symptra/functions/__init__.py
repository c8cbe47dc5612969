"""Column expressions and small DataFrame helpers shared by the operators."""

from .columns import (
    bands,
    format_interval,
    format_significant,
    inverse_logit,
    lognormal_density,
    normal_cdf,
    strict,
    strict_sum,
)
from .frames import (
    assert_complete,
    attach_group_stats,
    quantile_bands,
    ranked_quantiles,
    shared_dir,
    stored,
    with_draws,
    with_range_bucket,
)

__all__ = [
    "assert_complete",
    "attach_group_stats",
    "bands",
    "format_interval",
    "format_significant",
    "inverse_logit",
    "lognormal_density",
    "normal_cdf",
    "quantile_bands",
    "ranked_quantiles",
    "shared_dir",
    "stored",
    "strict",
    "strict_sum",
    "with_draws",
    "with_range_bucket",
]
