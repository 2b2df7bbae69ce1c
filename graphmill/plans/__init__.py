"""The graph queries: both modules register theirs in queries.QUERIES."""

from graphmill.plans import models, queries  # noqa: F401
