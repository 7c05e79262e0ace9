"""The registry of this engine's queries and their SQL twins."""

from __future__ import annotations

from legispark.plans import answers, audits, evidence, relational, retrieval, runs, texts, trees  # noqa: F401
from legispark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
