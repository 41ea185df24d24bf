import glob
import os

import duckdb
import pytest

import __spark_entry__
from nearfold.llm import queries as registered

from ..oracle import connect, same_rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "tab string, first_key bigint, copy_key bigint", "p1_copies": "tab string, first_key bigint, copies bigint", "p2_found": "ord_a bigint, ord_b bigint", "p2_classes": "member bigint, class_key bigint", "p3_found": "member string, group_key string",
    "p4_found": "medium string, ord_a bigint, ord_b bigint", "p5_found": "seen_ord bigint, new_ord bigint, how string", "p6_ids": "doc_id bigint, ids array<int>",
    "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert ", ".join(f"{n} {k}" for n, k in df.dtypes) == COLUMNS[name]
    assert df.count() > 0 or name == "p8_found"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, name):
    same_rows(connect(FOLDER), registered.oracle_sql()[name], registered.queries()[name](spark, FOLDER))


@pytest.fixture(scope="module")
def empty_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        duckdb.connect().execute(f"COPY (SELECT * FROM '{path}' LIMIT 0) TO '{folder}/{os.path.basename(path)}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_empty_tables(spark, empty_folder, name):
    assert registered.queries()[name](spark, empty_folder).count() == 0
