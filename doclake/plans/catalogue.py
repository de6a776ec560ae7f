"""All queries of the core, by name."""

from __future__ import annotations

from doclake.plans import library, problem_sql, problems, round_queries

_PROBLEMS = ("p1_found", "p1_tables", "p2_found", "p2_cases", "p3_found", "p3_counts", "p4_found", "p4_counts", "p5_found", "p5_paths", "p5_descendants")
QUERIES = {n: getattr(problems, n) for n in _PROBLEMS} | library.QUERIES | round_queries.QUERIES
ORACLES = problem_sql.ORACLES | library.ORACLES | round_queries.ORACLES
