"""The query modules for training data."""

from vitrine.llm import queries_core, queries_text

MODULES = [queries_core, queries_text]
