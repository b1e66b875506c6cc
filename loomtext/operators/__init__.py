"""Relational operators over patterns and vocabularies."""

from .joins import fuzzy_join, named_list_join, pattern_join, substring_join
from .rows import explode_matches, explode_splits, next_match

__all__ = ["explode_matches", "explode_splits", "fuzzy_join", "named_list_join", "next_match", "pattern_join", "substring_join"]
