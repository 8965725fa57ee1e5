"""Operators over DataFrames: joins, aggregation, windows, ordering, similarity search."""

from .aggregate import global_agg, group_agg
from .join import PREFIX, equi_join, rename_right, similarity_join
from .order import distinct, limit_offset, order_by, union
from .search import similarity_topk, threshold_filter
from .window import lag, lead, offset_window, rank_window, running, running_vec

__all__ = [
    "PREFIX", "distinct", "equi_join", "global_agg", "group_agg", "lag", "lead", "limit_offset", "offset_window", "order_by", "rank_window",
    "rename_right", "running", "running_vec", "similarity_join", "similarity_topk", "threshold_filter", "union",
]
