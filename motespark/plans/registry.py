"""All queries of the core, by name."""

from motespark.plans import core_problems, image_queries, link_queries, motion_queries, scalar_queries, static_queries

FLAGSHIP = "emsd"
_MODULES = (motion_queries, static_queries, link_queries, image_queries, scalar_queries, core_problems)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
