"""Lists of occurrences and of hashes are whole and in order."""

import duckdb
from conftest import same_rows

from assetloom.plans import registry


def test_lists_equal_sql(spark, tmp_path):
    rows = [(k * 997 - 5_000, f"text {k % 9}" if k % 4 else None if k % 8 else "", f"s{k % 3}" if k % 5 else None, k % 13) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    c.execute("CREATE TABLE labels (doc_id BIGINT)")
    for name, column in (("exact_dup_canonical", "occurrences"), ("hash_union_catalog", "hashes")):
        assert column in registry.QUERIES[name](spark, str(tmp_path)).columns
        same_rows(registry.QUERIES[name](spark, str(tmp_path)), c, registry.ORACLE[name])
