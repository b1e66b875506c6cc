"""Column functions: a pattern over a text column, planned into the cheapest form that keeps its meaning."""

from .columns import (
    count,
    enumerate_splits,
    escape,
    expand,
    expand_format,
    findall,
    full_match,
    group_value,
    is_full_match,
    is_match,
    is_match_at_start,
    match_at_start,
    matches,
    register,
    replace,
    replace_format,
    replace_n,
    replace_with,
    search,
    spans,
    split,
    tier,
)

__all__ = [
    "count", "enumerate_splits", "escape", "expand", "expand_format", "findall", "full_match", "group_value", "is_full_match", "is_match", "is_match_at_start", "match_at_start", "matches",
    "register", "replace", "replace_format", "replace_n", "replace_with", "search", "spans", "split", "tier",
]
