"""What the search asks of its steps: anything of these shapes can take their place."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Selection(Protocol):
    """(draw, tree_id) for the draws (draw, u) from trees (tree_id, fitness)."""

    def __call__(self, fitness: DataFrame, drawn: DataFrame) -> DataFrame: ...


class Crossover(Protocol):
    """Nodes of the children, by child as tree_id, of pairs (child, first, second) of parents."""

    def __call__(self, pairs: DataFrame, nodes: DataFrame, seed: int, max_depth: int) -> DataFrame: ...


class Mutation(Protocol):
    """Nodes of the same trees, each still valid."""

    def __call__(self, nodes: DataFrame) -> DataFrame: ...
