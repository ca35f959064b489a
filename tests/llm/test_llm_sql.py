import brute
import duckdb
import pytest
from compare import same

from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op2_shard", "op8_lines", "op10_mix"])
def test_awkward_rows_against_sql(spark, tmp_path, name):
    """Null and repeated ids, null, empty and long texts, null sources."""
    rows = brute.corpus(51, 60) + [(None, "a b", "en", "a"), (None, "a b", "en", "a"), (None, "c", "en", None), (None, None, None, None), (1, "c d e", "en", "b")]
    brute.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df())
