"""All queries of the document pipeline and its analytics, and the SQL that they are compared with."""

from __future__ import annotations

from quillstream.plans import analytics, artefacts, lookups, messages, records, validity

QUERIES = messages.QUERIES | analytics.QUERIES | records.QUERIES | validity.QUERIES | lookups.QUERIES | artefacts.QUERIES
ORACLES = messages.ORACLES | analytics.ORACLES | records.ORACLES | validity.ORACLES | lookups.ORACLES | artefacts.ORACLES
