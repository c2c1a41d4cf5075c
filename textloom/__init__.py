"""Textloom: text retrieval, corpus analytics and query-log analytics as Spark plans."""
