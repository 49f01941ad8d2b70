"""The feature query language: text to syntax tree."""

from chronofold.fql.parser import QueryError, parse_feature, parse_query, parse_select

__all__ = ["QueryError", "parse_feature", "parse_query", "parse_select"]
