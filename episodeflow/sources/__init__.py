from episodeflow.sources.tables import TABLES, read_table  # noqa: F401
