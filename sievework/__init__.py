"""Spark-native engine for code-corpus verification: blocks, similarity, spans, call graphs, ranking and judging."""
