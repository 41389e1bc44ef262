"""All queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from opinara.plans import flows, labels, reviews, texts

_ALL = [reviews.C, labels.C, texts.C, flows.C]
QUERIES = {k: f for c in _ALL for k, f in c.queries.items()}
ORACLES = {k: s for c in _ALL for k, s in c.oracles.items()}
