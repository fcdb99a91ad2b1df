"""All registered queries outside the training-data subpackage."""

from paperloom.plans import decide, evidence, more, packages, packs, review, streams, texts

MODULES = (decide, texts, review, streams, more, packs, evidence, packages)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
