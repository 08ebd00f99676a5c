"""Reports as a text column, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.quality import with_quality
from pagemill.functions.text import bound
from pagemill.operators.prefix import prefix_sums
from pagemill.plans import planning as P
from pagemill.plans import views as V
from pagemill.plans.batches import batch_summary


def plan_report(plan: Column) -> Column:
    """A split plan as a few lines."""
    lines = F.array_compact(
        F.array(
            F.format_string("📊 División recomendada: %d archivos", plan["num_files"]),
            F.format_string("   • Páginas por archivo: %d", plan["pages_per_file"]),
            F.format_string("   • Tamaño estimado por archivo: %.1f MB", plan["mb_per_file"]),
            F.concat(F.lit("   • Estrategia: "), plan["strategy"]),
            F.format_string("   • Puntuación de eficiencia: %.0f%%", plan["score"] * 100),
            F.when(F.size(plan["warnings"]) > 0, F.concat(F.lit("   ⚠️ Advertencias: "), F.array_join(plan["warnings"], ", "))),
        )
    )
    whole = F.lit("✅ No se requiere división\n   El archivo puede procesarse directamente")
    return F.when(plan.isNull(), "").when(plan["num_files"] == 1, whole).otherwise(F.array_join(lines, "\n"))


def quality_report(prefix: str = "") -> Column:
    """The columns of with_quality as a few lines."""
    c = lambda name: F.col(f"{prefix}{name}")
    return F.concat_ws(
        "\n",
        F.format_string("Score: %.2f/100", c("score")),
        F.format_string("Palabras: %d, caracteres: %d", c("total_words"), c("total_chars")),
        F.format_string("Patrones sospechosos: %d, caracteres raros: %d", c("suspicious_patterns"), c("rare_chars_count")),
        F.concat(F.lit("- "), F.array_join(c("issues"), "\n- ")),
    )


def plan_reports(spark, d):
    """RPT1: reports of split plans."""
    f = P.with_split_needs(V.big_files(spark, d)).withColumn("plan", P.optimal_plan())
    return f.select("file_id", plan_report(F.col("plan")).alias("report"))


def quality_reports(spark, d):
    """RPT1: reports of quality."""
    return with_quality(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", quality_report().alias("report"))


def estimation_report(name: Column, n: Column, limits: P.Limits = P.PRE_DIVISION) -> Column:
    """What a division of a file of with_split_needs into n parts would give, as lines; a file has at most a few parts."""

    # even parts have two sizes at most, so what tells of a size is formatted once for each
    def told(count: Column) -> Column:
        mb = P.estimated_mb(count)
        over = mb > limits.max_size_mb
        says = F.format_string(": ~%.1fMB (%d pág) %s\n  └─ ", mb, count, F.when(over, "❌ EXCEDE").otherwise("✅ OK"))
        return F.struct(count.alias("pages"), says.alias("says"), F.when(over, F.format_string("\n  └─ 💡 Recomendación: dividir en %d partes", P.ceil_div(mb, limits.max_size_mb))).otherwise("").alias("advice"))

    def part(k: Column, before: Column, size: Column) -> Column:
        return F.concat(F.lit("Archivo "), (k + 1).cast("string"), size["says"], (before + 1).cast("string"), F.lit("-"), (before + size["pages"]).cast("string"), size["advice"])

    sizes = bound(P.even_split(n), lambda s: F.struct(s["extra"].alias("extra"), told(s["base"]).alias("small"), told(s["base"] + 1).alias("large")))
    large, small = lambda t, k: part(k, k * t["large"]["pages"], t["large"]), lambda t, k: part(k, k * t["small"]["pages"] + t["extra"], t["small"])
    lines = bound(sizes, lambda t: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.when(k < t["extra"], large(t, k)).otherwise(small(t, k))))
    head = lambda plan: F.format_string(
        "📊 REPORTE DE ESTIMACIÓN PRE-DIVISIÓN\n📄 Archivo: %s\n📏 Tamaño original: %.1f MB\n📑 Total páginas: %,d\n🔢 Archivos solicitados: %d\n💡 Archivos recomendados: %d\n⚡ Eficiencia de tamaño: %.0f%%\n\n📋 ESTIMACIONES POR ARCHIVO:",
        name, F.col("size_mb"), F.col("total_pages"), n, F.col("required_files"), plan["efficiency"] * 100,
    )
    trouble = lambda plan: F.format_string("\n🚨 PROBLEMAS DETECTADOS:\n❌ %d archivos excederán el límite de 50MB\n💡 Se recomienda usar %d archivos en su lugar", plan["n_exceeding"], F.col("required_files"))
    return bound(P.pre_division(n, limits), lambda plan: F.array_join(F.array_compact(F.concat(F.array(head(plan)), lines, F.array(F.when(~plan["all_within"], trouble(plan))))), "\n"))


def batch_report(files: DataFrame, batch: str, order: str, limits: P.Limits = P.Limits()) -> DataFrame:
    """`batch, line_no, line`: the report of each batch as rows, so that a batch may have any number of files.

    Line 0 is the summary; a file has the line of its place, from 1. Page offsets are running sums by ranges.
    """
    planned = P.with_split_needs(files, limits).withColumn("plan", P.optimal_plan(limits))
    placed = prefix_sums(planned, [batch], [F.col(order)], {"line_no": F.lit(1).cast("long"), "until": F.coalesce("total_pages", F.lit(0)).cast("long")})
    first = F.col("until") - F.coalesce("total_pages", F.lit(0)) + 1
    told = F.format_string("%d. %s\n   📊 Tamaño: %.1f MB\n   📄 Páginas: %d (desde página %d)\n   🎯 Densidad: %.2f MB/página", F.col("line_no"), F.col("file_id").cast("string"), F.col("size_mb"), F.col("total_pages"), first, F.col("density"))
    cut = F.format_string("\n   📂 División: %d archivos\n   📑 Páginas por archivo: %d\n   💾 MB por archivo: %.1f\n   🏆 Eficiencia: %.0f%%", F.col("plan.num_files"), F.col("plan.pages_per_file"), F.col("plan.mb_per_file"), F.col("plan.score") * 100)
    how = F.when(F.col("plan").isNull(), "").when(F.col("plan.num_files") == 1, "\n   ✅ No requiere división").otherwise(cut)
    rows = placed.select(batch, "line_no", F.concat(told, how).alias("line"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("\n⚠️ ADVERTENCIAS:\n  • "), F.array_join("warnings", "\n  • "))).otherwise("")
    head = F.format_string("Archivos a procesar: %d\nTamaño total: %.1f MB\nPáginas totales: %d\nDensidad promedio: %.2f MB/página\nArchivos estimados tras división: %d\nTiempo estimado: %.1f minutos\nEstrategia global: %s", F.col("n_files"), F.col("size_mb"), F.col("total_pages"), F.col("avg_density"), F.col("n_parts"), F.col("minutes"), F.col("strategy"))
    return batch_summary(files, batch, limits).select(batch, F.lit(0).cast("long").alias("line_no"), F.concat(head, warned).alias("line")).unionByName(rows)


def batch_reports(spark, d):
    """RPT1: reports of batches, a row a line."""
    return batch_report(V.files(spark, d), "batch_id", "file_id")


def estimation_reports(spark, d):
    """RPT1: reports of estimated divisions."""
    f = P.with_split_needs(V.big_files(spark, d), P.PRE_DIVISION)
    return f.select("file_id", estimation_report(F.col("file_id").cast("string"), F.least(F.col("required_files"), F.lit(20))).alias("report"))
