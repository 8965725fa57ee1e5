"""The query language: lexer, parser and compiler to DataFrames."""

from .compiler import Compiler, QueryError
from .lexer import ParseError, split_statements
from .statements import parse

__all__ = ["Compiler", "ParseError", "QueryError", "parse", "split_statements"]
