from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.operators import numeric as N
from pagemill.plans import batches as B
from pagemill.plans import planning as P
from pagemill.plans.reports import estimation_report
from pagemill.plans import reports


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("a", 45.0, 120), ("b", 127.3, 850), ("c", 265.0, 1060), ("d", 5000.0, 100)], "file_id string, size_mb double, total_pages int")


def test_plans(files):
    rows = {r["file_id"]: r for r in P.with_split_needs(files).withColumns({"best": P.optimal_plan(), "others": P.alternative_plans()}).collect()}
    assert rows["a"]["best"]["num_files"] == 1 and rows["a"]["best"]["strategy"] == "no-split-required"
    assert (rows["b"]["required_files"], rows["b"]["reason"]) == (2, "size") and rows["b"]["best"]["score"] > 0.8
    assert rows["d"]["best"] is None and len(rows["c"]["others"]) <= 3


def test_parts_cover_all_pages(files):
    rows = P.expand_parts(files, P.split_target(96.0, 900)).groupBy("file_id", "total_pages").agg(F.sum("n_pages").alias("n")).collect()
    assert all(r["n"] == r["total_pages"] for r in rows)
    parts = files.select("total_pages", F.explode(P.estimated_parts(F.lit(5))).alias("p")).groupBy("total_pages").agg(F.sum("p.pages").alias("n"), F.max("p.last_page").alias("last")).collect()
    assert all(r["n"] == r["last"] == r["total_pages"] for r in parts)


def test_greedy_chunks(spark):
    pages = spark.createDataFrame([(1, k, s) for k, s in enumerate((5.0, 5.0, 5.0, 50.0, 1.0))], "doc_id long, page_idx int, size double")
    assert [r["chunk"] for r in P.greedy_chunks(pages, 2, 20.0).orderBy("page_idx").collect()] == [0, 0, 1, 2, 3]


def test_names_in_natural_order(spark):
    names = ["anexo", "Tomo_10.pdf", "vol 2.pdf", "x/parte-3"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(B.order_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["vol 2.pdf", "x/parte-3", "Tomo_10.pdf", "anexo"]


def test_upload_cache_counts_from_the_last_miss(spark):
    rows = [("h", f"2024-01-01 {h:02d}:00:00") for h in (0, 11, 13, 23)]
    found = spark.createDataFrame(rows, "content_hash string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["hit"] for r in N.upload_cache_hits(found).orderBy("ts").collect()] == [False, True, False, True]


def test_errors_and_buckets(spark):
    row = spark.range(1).select(B.error_class(F.lit("HTTP 429")), B.error_class(F.lit("code 3310")), B.error_class(F.lit(None).cast("string")), B.size_bucket(F.lit(10.0)), B.traffic_light(F.lit(50.0))).first()
    assert tuple(row) == ("rate_limit", "url_fetch", "none", "medium", "warn")


def test_batch_reports_have_a_line_a_file(spark):
    files = spark.createDataFrame([("b", "x", 20.0, 100), ("b", "y", 200.0, 300), ("c", "z", 1.0, None)], "batch_id string, file_id string, size_mb double, total_pages int")
    found = {(r.batch_id, r.line_no): r.line for r in reports.batch_report(files, "batch_id", "file_id").collect()}
    assert found["b", 0].startswith("Archivos a procesar: 2\nTamaño total: 220.0 MB\nPáginas totales: 400\n")
    assert "2. y\n" in found["b", 2] and "(desde página 101)" in found["b", 2] and "📂 División: 3 archivos" in found["b", 2] and "✅ No requiere" in found["b", 1]
    assert set(found) == {("b", 0), ("b", 1), ("b", 2), ("c", 0), ("c", 1)}


def test_estimation_report(spark):
    f = P.with_split_needs(spark.createDataFrame([("x", 130.0, 100)], "file_id string, size_mb double, total_pages int"), P.PRE_DIVISION)
    text = f.select(reports.estimation_report(F.col("file_id"), F.lit(2)).alias("t")).first()["t"]
    assert "Archivo 1: ~" in text and "❌ EXCEDE\n  └─ 1-50\n  └─ 💡 Recomendación: dividir en 2 partes" in text and "❌ 2 archivos excederán" in text


def test_estimates_of_many_parts(spark):
    n = 20_000
    files = spark.createDataFrame([(3.0 * n, 2 * n + 7)], "size_mb double, total_pages int")
    p = files.select(P.estimated_parts(F.lit(n)).alias("p"), P.pre_division(F.lit(n)).alias("d")).first()
    assert [x.first_page for x in p.p[:9]] == [1, 4, 7, 10, 13, 16, 19, 22, 24]
    assert p.p[-1].last_page == 2 * n + 7 and all(a.last_page + 1 == b.first_page for a, b in zip(p.p, p.p[1:]))
    mbs = [x.mb for x in p.p]
    assert (p.d.num_files, p.d.n_exceeding, p.d.max_mb) == (n, sum(x.exceeds for x in p.p), max(mbs))


def test_report_of_an_estimated_division(spark):
    files = P.with_split_needs(spark.createDataFrame([(1, 130.0, 7)], "file_id long, size_mb double, total_pages int"), P.PRE_DIVISION)
    report = files.select(estimation_report(F.lit("f"), F.lit(2))).first()[0]
    assert report.split("ARCHIVO:\n")[1].split("\n") == [
        "Archivo 1: ~76.5MB (4 pág) ❌ EXCEDE", "  └─ 1-4", "  └─ 💡 Recomendación: dividir en 2 partes",
        "Archivo 2: ~57.4MB (3 pág) ❌ EXCEDE", "  └─ 5-7", "  └─ 💡 Recomendación: dividir en 2 partes",
        "", "🚨 PROBLEMAS DETECTADOS:", "❌ 2 archivos excederán el límite de 50MB", f"💡 Se recomienda usar {files.first().required_files} archivos en su lugar",
    ]
