"""Query catalog: named Spark queries over a table directory, each with the
equivalent DuckDB SQL where one exists (the correctness oracle)."""

from shelfcast.plans.registry import QUERIES, ORACLES, register

__all__ = ["QUERIES", "ORACLES", "register"]
