"""All queries of the subpackage; each module registers its own."""

from __future__ import annotations

from callweave.llm import queries_edits, queries_leaks, queries_neighbours, queries_personal, queries_survivors, queries_tokens  # noqa: F401
from callweave.llm.registry import QUERIES, SQL  # noqa: F401
