"""The reports (named analytics, documented examples, described computations, operations)
and the DuckDB SQL that states each of them independently."""
