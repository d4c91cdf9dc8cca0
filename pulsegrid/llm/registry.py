"""Queries of this subpackage and the SQL that states the same rows, where SQL can."""

QUERIES = {}
SQL = {}

#: White space and words of every contract here: ASCII blanks only.
BLANKS = r"[\x20\x09-\x0D]+"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load_all():
    from pulsegrid.llm import queries  # noqa: F401

    return QUERIES, SQL


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
