"""Small tables with the cases every operator must handle."""

import duckdb
import pytest

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
NEAR = BASE.replace("alpha60", "changed")
ODD_TEXTS = [
    (1, BASE, "b"),
    (2, NEAR, "a"),
    (3, BASE, None),
    (4, None, "a"),
    (5, "", None),
    (6, " \n\t ", "b"),
    (7, "one", "c"),
    (8, "one", "c"),
    (9, LONG, "ä"),
    (10, LONG, "z"),
    (11, "ÄÖ two words 日本 \U0001f642 " + BASE, "z"),
    (12, BASE, "b"),
    (12, BASE, "b"),
    (None, BASE, "c"),
    (None, "nobody's text", None),
]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, texts and sources, empty, blank, long and equal texts, repeated rows."""
    return spark.createDataFrame(ODD_TEXTS, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns named like the operators' own."""
    import pyspark.sql.functions as F

    names = ["id", "kept", "size", "rank", "score", "shard", "found", "position", "epoch", "n_words", "cluster", "u", "v", "part", "chunk", "rule", "path"]
    return odd.withColumns({name: F.lit(f"own {name}") for name in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(sf_dir):
    """Rows of the given tables, by SQL."""
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return lambda sql: con.execute(sql).fetchall()
