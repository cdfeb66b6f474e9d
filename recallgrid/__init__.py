"""Associative retrieval over large record collections on Spark: exact, vector, text, graph, sequence and pattern queries."""
