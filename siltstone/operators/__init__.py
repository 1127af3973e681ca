"""Operators that Spark lacks, as rewrites to DataFrame operations."""

from .joins import asof_join, broadcast_if_small, overlap_join, range_join, salted_join
from .partial import moments, two_phase
from .quantiles import exact_quantiles
from .ranges import global_ranks, numbered, range_sums, ranged_asof_join, ranged_overlap_join, rows_frame, running_sums
from .similar import build_index, recall_of, top_k_exact, top_k_indexed
from .upsert import upsert

__all__ = [
    "asof_join", "broadcast_if_small", "build_index", "exact_quantiles", "global_ranks", "moments", "numbered", "overlap_join", "range_join", "range_sums", "ranged_asof_join", "ranged_overlap_join", "recall_of", "rows_frame", "running_sums", "salted_join", "top_k_exact", "top_k_indexed", "two_phase", "upsert",
]
