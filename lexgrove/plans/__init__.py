"""The registered queries; importing the package registers them all."""

from . import definition_queries, file_queries, order_queries, relation_queries, stream_queries, string_queries, symbol_queries, text_queries  # noqa: F401
