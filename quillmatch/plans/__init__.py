"""Queries composed of the operators."""

from . import code_queries, match_queries, module_queries, text_queries, tree_queries
from .registry import ORACLE, QUERIES
from .text_queries import translit_turn_similarity as flagship

__all__ = ["ORACLE", "QUERIES", "code_queries", "flagship", "match_queries", "module_queries", "text_queries", "tree_queries"]
