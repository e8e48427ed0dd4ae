"""Every registered query of the core library gives its oracle's rows at the smallest scale."""

import math
import os
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return f"{float(value):.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, oracle, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    sql = catalog.oracle_sql()[name]
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = oracle.execute(f"select {quoted} from ({sql})").fetchall()
    assert found == sorted(tuple(map(plain, r)) for r in wanted)


#: Queries that SQL can't express; other tests hold them against plain Python.
PLAIN = {"slot_evidence", "beam_evidence", "near_copies_collapsed", "query_set_digests", "document_chunks", "code_chunks", "table_chunks", "page_texts", "sectioned_chunks", "typed_pages"}


def test_every_other_core_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | PLAIN


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 10


def test_optional_part_is_only_added():
    assert set(catalog.queries()) <= set(entry.queries())


def test_core_never_names_the_optional_part():
    root = Path(os.path.dirname(catalog.__file__)).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "tidemark.llm" not in file.read_text()
