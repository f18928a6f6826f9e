import glob
import os

import duckdb
import pytest

from leafmill.plans import catalogue

DATA = "/root/testdata/sf0.001"


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in glob.glob(DATA + "/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_empty_tables(spark, tmp_path):
    for f in glob.glob(DATA + "/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(str(tmp_path / os.path.basename(f)))
    for name, f in catalogue.queries().items():
        f(spark, str(tmp_path)).collect()
