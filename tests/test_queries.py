import duckdb
import pytest

from maintspark.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall()), key=str)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=str)
    assert got == want
