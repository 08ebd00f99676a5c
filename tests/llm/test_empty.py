"""Empty tables, and tables of nulls and empty texts only, give empty or whole results."""

from __future__ import annotations

import pytest

from pagemill.llm import line_dedup, minhash_join, multiset_hash, secrets, suffix_dedup, warc
from pagemill.llm.shared import shared_folder

SCHEMA = "doc_id long, text string"
OPERATORS = {
    "line dedup": line_dedup.dedup_lines,
    "suffix dedup": suffix_dedup.remove_repeats,
    "fingerprints": multiset_hash.fingerprints,
    "join": minhash_join.similar_documents,
    "secrets": lambda docs: secrets.scan(docs, secrets.train(docs)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows_and_no_text(spark, name):
    operator = OPERATORS[name]
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    assert operator(spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n ")], SCHEMA)).count() == 4


def test_no_pages(spark):
    folder = shared_folder(spark, "none")
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(manifest, folder).count() == 0
