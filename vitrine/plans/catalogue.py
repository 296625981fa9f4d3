"""The query modules of the engine."""

from vitrine.plans import evaluation, events, foundation, learning, reporting, retrieval, understanding

MODULES = [foundation, retrieval, evaluation, understanding, learning, events, reporting]
