"""Column constants, ranks of kinds and relations, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: relations and symbol kinds in their canonical orders, and what each kind is
RELATIONS = ("CALLS", "CALLS_CANDIDATE", "IMPORTS", "IMPLEMENTS")
CERTAIN = ("CALLS", "IMPORTS", "IMPLEMENTS")
KINDS = ("module", "struct", "enum", "trait", "function", "method")
KIND_TAGS = {"module": "mod", "struct": "struct", "enum": "enum", "trait": "trait", "function": "fn", "method": "method"}
CALLABLE = ("function", "method")
TYPES = ("struct", "enum", "trait")
TREE_KINDS = ("module", "trait", "struct", "enum", "function", "method")
IMPACT_DEPTH, IMPACT_NODES = 8, 5_000
QUERY_DEPTH, QUERY_NODES, QUERY_RESULTS = 10, 500, 50
EVIDENCE_SAMPLES, CANDIDATES_LISTED = 5, 25
GRAPH_FORMAT = 2

NODE_COLUMNS = ("repo_id", "id", "kind", "name", "qualified_name", "file", "start_line", "end_line", "parent", "module", "is_test")


class GraphError(ValueError):
    """A request that names nothing, too much, or something of the wrong kind."""


class NotFound(GraphError):
    pass


class Ambiguous(GraphError):
    def __init__(self, text: str, candidates: list[str]):
        super().__init__(f"{text!r} may mean: {', '.join(candidates)}")
        self.candidates = candidates


class OutdatedIndex(GraphError):
    pass


class InvalidArgument(GraphError):
    pass


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order; unknown values come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, F.lit(i)).otherwise(out)
    return out


def rounded(c: Column, places: int) -> Column:
    """Half away from zero on the binary value, for values that are not negative."""
    k = 10.0**places
    return F.floor(c * k + 0.5) / k


def depth_within(depth: int, most: int = QUERY_DEPTH) -> int:
    if not 1 <= depth <= most:
        raise InvalidArgument(f"depth must be from 1 to {most}")
    return depth
