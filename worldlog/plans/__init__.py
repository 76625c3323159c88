"""The registered queries of the library and the SQL that each is held against."""

from . import analysis, assess, connect, findings, ingest, mission, reads, state, story, text, timed, views, world

FLAGSHIP = "q01_mission_view"
_ALL = (state, analysis, text, views, ingest, reads, world, assess, connect, mission, timed, story, findings)
QUERIES: dict = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _ALL for name, sql in module.SQL.items()}
