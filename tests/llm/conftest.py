import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def llm_queries():
    from quill.llm import queries
    return queries


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return con


@pytest.fixture(scope="session")
def doc_texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


#: nulls, empty and long texts, ties and repeated rows
ODD_TEXTS = [None, "", " ", "\n\t", "a", "one two", "one two three", "One TWO three", "x" * 5000, "é ü ñ " * 400,
             "   wide", "1234 5678 !!", "one two three", "🙂 smile", "I'll we've it's  end\r\n", None]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", 7, "mine", 1.5, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], (None, "null id", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "lang_pred string, score double, shard int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
