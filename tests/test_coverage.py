"""Coverage is one aggregation by region: no joins, and null keys are a region of their own, as in the SQL."""

import duckdb

from quillmark import catalog


def test_null_regions_without_joins(spark, tmp_path):
    rows = [(1, 1, 40.0, 0.0), (1, 1, 10.0, 0.09), (1, None, 40.0, 0.0), (1, None, 5.0, 0.0), (2, 1, 5.0, 0.09), (2, 2, 5.0, 0.0), (None, 3, 40.0, 0.0), (3, 1, None, 0.01)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    df = catalog.queries()["extraction_coverage"](spark, str(tmp_path)).where("doc_id is null or doc_id < 3")
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()['extraction_coverage']}) where doc_id is null or doc_id < 3").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
