"""relspark: a relational SQL dialect, transactional tables and corpus operators on Spark."""

apilevel = "2.0"
threadsafety = 1
paramstyle = "qmark"


def connect(path: str = ":memory:", **how):
    """A database in memory or in a folder."""
    from .sources.database import Database

    return Database(path, **how)
