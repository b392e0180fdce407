"""All registered queries of the record operators and their SQL."""

from __future__ import annotations

from . import answers, documents, extraction, intake, records, stages, surface

QUERIES: dict = documents.QUERIES | records.QUERIES | answers.QUERIES | extraction.QUERIES | intake.QUERIES | surface.QUERIES | stages.QUERIES
SQL: dict = documents.SQL | records.SQL | answers.SQL | extraction.SQL | intake.SQL | surface.SQL | stages.SQL
