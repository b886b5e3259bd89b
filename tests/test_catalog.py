"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessera.functions import text as T
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    found = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_terms_keep_whole_characters(spark):
    df = spark.createDataFrame([("a𝄞 bé",), ("",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(T.terms("t")).collect()]
    assert got == [["a𝄞", "𝄞b", "bé", "a", "b"], [], ["x"], None]


def test_rules_see_the_whole_text(spark, tmp_path):
    rows = [(4, "long words " * 20_000 + "\n运用通用水量平衡方程计算生态系统的水源涵养量，\n" + "more words " * 20, "s", "zh", 4), (8, "nothing", "s", "en", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.QUERIES["rule_extraction"](spark, str(tmp_path)).collect()] == [(4, "uses_formula", "水源涵养量", "水量平衡方程")]


def test_whole_tables_are_reconciled(spark, tmp_path):
    spark.createDataFrame([(3,), (4,), (6,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(4, 3), (6, 1), (6, 5), (9, 4)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.code: r.n for r in catalog.QUERIES["validation_whole"](spark, str(tmp_path)).collect()}
    assert got == {"missing_prediction": 1, "duplicate_prediction": 1, "unknown_unit": 1}
