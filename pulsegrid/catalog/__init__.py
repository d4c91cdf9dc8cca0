"""Every query of the engine, with the SQL that states the same result where SQL can."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load_all():
    from pulsegrid.catalog import detail, events, jobs, vectors  # noqa: F401

    return QUERIES, SQL
