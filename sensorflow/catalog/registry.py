"""All queries and their checking SQL."""

from __future__ import annotations

from sensorflow.catalog import models, preparation, reports

ENTRIES = {**preparation.ENTRIES, **reports.ENTRIES, **models.ENTRIES}
QUERIES = {name: build for name, (build, _) in ENTRIES.items()}
CHECKS = {name: check for name, (_, check) in ENTRIES.items() if check is not None}
