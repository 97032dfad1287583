"""Every registered query and its SQL."""

from __future__ import annotations

from tidelane.plans import domain, engine, files, folded, games, images, temporal

QUERIES = temporal.QUERIES | domain.QUERIES | folded.QUERIES | engine.QUERIES | games.QUERIES | files.QUERIES | images.QUERIES
ORACLE_SQL = temporal.ORACLE_SQL | domain.ORACLE_SQL | folded.ORACLE_SQL | engine.ORACLE_SQL | games.ORACLE_SQL | files.ORACLE_SQL | images.ORACLE_SQL
