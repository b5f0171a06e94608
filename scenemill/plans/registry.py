"""Every query of the scoring and curation operators, with the SQL it is compared with."""

from . import curating, exporting, geometry, scoring, shaping, staging, turning, validating

QUERIES = {**scoring.QUERIES, **curating.QUERIES, **exporting.QUERIES, **geometry.QUERIES, **shaping.QUERIES, **staging.QUERIES, **turning.QUERIES, **validating.QUERIES}
ORACLE_SQL = {**scoring.ORACLE_SQL, **curating.ORACLE_SQL, **exporting.ORACLE_SQL, **geometry.ORACLE_SQL, **shaping.ORACLE_SQL, **staging.ORACLE_SQL, **turning.ORACLE_SQL, **validating.ORACLE_SQL}
