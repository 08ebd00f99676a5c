"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from pagemill.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    want, got = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table(), registry.QUERIES[name](spark, FOLDER).toArrow()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = [Counter(repr(tuple(r[c] for c in columns)) for r in x.to_pylist()) for x in (got, want)]
    assert rows[0] == rows[1]


#: Lines that are articles, fractions, subsections, amendments or rules by their text, wherever they stand.
ODD_LINES = ["I. uno", "IIX. no", "(X) dos", "Inciso IV tres", "Fracción XIIa no", "a) uno", "b - dos", "C) tres", "(d) cuatro", "ab) no", "x.- cinco", "---", " ----- ", "--", "Art. 5 más", "## ARTÍCULO 6o.", "artículo sin",
    "Fracción reformada DOF 02-03-2011", "*Párrafo adicionado DOF 01-02-2020*", "**Inciso adicionado DOF 01-02-2020", "(DEROGADO)", "  Se derogan varios \xa0", "", " ", "\t* e) seis\r", "solo texto\r", "\x0b I: con", "İ. no", "> ii. no", "M-"]


@pytest.mark.parametrize("name", ["legal_counts", "legal_intros", "legal_structure"])
def test_laws_by_their_text(spark, tmp_path, name):
    texts = ["\n".join(ODD_LINES[(k * i + i * i // 3) % len(ODD_LINES)] for i in range(40)) for k in range(1, 60)]
    docs = spark.createDataFrame([(k, t, "es", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(registry.ORACLE_SQL[name]).to_arrow_table(), registry.QUERIES[name](spark, str(tmp_path)).toArrow()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = [Counter(repr(tuple(r[c] for c in columns)) for r in x.to_pylist()) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["table_lines", "written_files"])
def test_texts_that_are_empty_or_end_in_a_line_end(spark, tmp_path, name):
    texts = ["", "uno", "\n", "", "a | b |\r\n| c\x0bd |", "dos\n\n"]
    docs = spark.createDataFrame([(7 * k, t, "es", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(registry.ORACLE_SQL[name]).to_arrow_table(), registry.QUERIES[name](spark, str(tmp_path)).toArrow()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = [Counter(repr(tuple(r[c] for c in columns)) for r in x.to_pylist()) for x in (got, want)]
    assert rows[0] == rows[1]
