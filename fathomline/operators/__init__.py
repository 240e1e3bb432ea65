"""The operators of the engine: recall, scoring, graph, packing, evaluation."""
