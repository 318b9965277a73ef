"""The training-data queries agree with their SQL on whole tables."""

from conftest import DATA
from test_entry import TABLES, plain

from credence.llm.queries import QUERIES
from credence.llm.sql import ORACLES


def test_every_query_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    bad = []
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, DATA)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        if sorted(columns) != sorted(df.columns) or plain(df.collect(), df.columns) != plain(found.fetchall(), columns):
            bad.append(name)
    assert not bad and len(ORACLES) >= 7
