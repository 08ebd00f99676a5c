from __future__ import annotations

import html
import html.entities
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import repair as R
from pagemill.functions.quality import with_quality
from pagemill.functions.text import composed
from pagemill.operators import assembly as A
from pagemill.operators import dictionary as D
from pagemill.operators import legal as L
from pagemill.operators import tables as T
from pagemill.operators.quality import compare_quality


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_quality_of_good_bad_and_empty_texts(spark):
    rows = [("good", "El artículo primero establece que todas las personas tienen derecho a la información"), ("bad", "rn cl vv ii Il lI rn cl ¦§¢£µ¶ a1b2 x9y8"), ("blank", " \n"), ("null", None)]
    found = {r["k"]: r for r in with_quality(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert found["good"]["score"] == 100 and found["good"]["issues"] == ["Sin problemas detectados"]
    assert found["bad"]["suspicious_patterns"] == 8 and found["bad"]["mixed_alphanum_words"] == 2 and found["bad"]["score"] < 50
    assert found["blank"]["score"] == found["null"]["score"] == 0 and found["null"]["total_chars"] == 0


def test_comparison(spark):
    row = compare_quality(spark.createDataFrame([("rn cl vv ii Il lI", "uno dos tres cuatro cinco seis siete ocho nueve diez")], "a string, b string"), "a", "b").first()
    assert row["summary"] == "significant" and row["score_after"] == 100


@pytest.mark.parametrize(
    ("text", "fixed"),
    [("a  b ,c", "a b, c"), ("docu-\nmento", "documento"), ("(abierto\nx", "(abierto)\nx"), ("x -- y", "x — y"), ("4O2 y l0", "402 y 10"), ("ARTICULO 2do 1/2", "ARTÍCULO 2 do ½"), ("I V y V I", "IV y VI"), (None, None)],
)
def test_repair(spark, text, fixed):
    assert one(spark, text, R.optimize_text) == fixed


def test_rules_are_pairs():
    assert R.load_rules([("a", "b")]) == [("a", "b")] and len(R.OCR_RULES) == 56
    for bad in ([("a",)], [("a", 1)], ["ab"]):
        with pytest.raises(ValueError, match="pair"):
            R.load_rules(bad)


def test_markdown_keeps_images_and_tables(spark):
    text = "# ARTICULO  uno\n![ARTICULO](x--y.png)\n<table><tr><td>4O2</td></tr></table>\n4O2"
    assert one(spark, text, R.optimize_markdown) == "# ARTÍCULO uno\n![ARTICULO](x--y.png)\n<table><tr><td>4O2</td></tr></table>\n402"


def test_plain_text_and_case_references(spark):
    assert one(spark, "# Uno\n\n![i](i)\n**dos** [tres](u) &lt;x&gt;", R.plain_text) == "Uno\ndos tres "
    assert one(spark, "**Encabezado:** *uno*\r\n  **Pie de página:** dos ", R.plain_text) == "Encabezado: uno\n  Pie de página: dos "
    assert one(spark, "a &lt; 2 <10> &#233;&#xF1;&oacute; &amp;lt; &#38;gt; <b c='d'>e</b>", R.plain_text) == "a < 2 10 éñó &lt; &gt; e"
    assert one(spark, "&#0;&#9999999; x", R.plain_text) == "\ufffd\ufffd x" and one(spark, None, R.plain_text) is None
    assert one(spark, "ver <1a.j. 35/2019 (10a.)> y <b>", R.escape_case_refs) == "ver &lt;1a.j. 35/2019 (10a.)&gt; y <b>"


def test_gated_rules(spark):
    rows = D.gated_rules(spark.createDataFrame([("casa rn 1/2 año",)], "text string"), rules=[(R.LETTER_PAIRS[0]), ("casa", "caza"), ("1/2", "½")]).first()
    assert rows["repaired"] == "casa m ½ año"
    assert [(h["rule"], h["original"], h["position"], h["applied"]) for h in rows["hits"]] == [(0, "rn", 5, True), (1, "casa", 0, False), (2, "1/2", 7, True)]


def test_correction_stats_counts_all_rules(spark, tmp_path, monkeypatch):
    from pagemill.plans import text_queries as Q

    docs = spark.createDataFrame([(1, "l5 cl µ 3/4"), (2, "3/4 3/4 casa"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(Q.V, "noisy", lambda spark, d: docs)
    at = {rule: k for k, (rule, _) in enumerate(R.OCR_RULES)}
    found = {(r["doc_id"], r["rule"]): (r["applied"], r["skipped"]) for r in Q.correction_stats(spark, str(tmp_path)).collect()}
    one, two, three, four = at[R.LETTERS_AND_DIGITS[0][0]], at[R.LETTER_PAIRS[2][0]], at["µ"], at["3/4"]
    # a hit alone lacks what the first rule looks ahead to, so it is held back, as in the reference; then "l5" is set apart
    assert found == {(1, one): (0, 1), (1, at[R.JOINED[0][0]]): (1, 0), (1, two): (1, 0), (1, three): (1, 0), (1, four): (1, 0), (2, four): (2, 0)}


def test_tables(spark):
    text = "antes\n| a | b |\n|---|---|\n| 1 | |\n| 2 | 3 |\n\nfin"
    lines = T.lines_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    found = T.find_tables(lines)
    row = found.first()
    assert found.count() == 1 and (row["start"], row["end"], row["rows"], row["cols"]) == (1, 4, 4, 2) or row["content"][0] == ["a", "b"]
    new = {r["doc_id"]: r["text"] for r in T.replace_tables(lines, found).collect()}
    assert new[1].startswith("antes\n| a | b |\n| --- | --- |\n") and new[1].endswith("\n\nfin")
    assert T.table_cells(found).where("cell = '3'").count() == 1


def test_legal_structure(spark):
    text = "Preámbulo\nArtículo 1o.- Uno\nI. Fracción\na) inciso\nPárrafo adicionado DOF 01-02-2020\nArtículo 2 Bis. Dos\n---\nsuelto\nArt. 3 Tres\n2 de 365"
    found = L.with_structure(L.legal_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    rows = found.orderBy("line_no").collect()
    assert [r["section"] for r in rows] == ["preamble"] + ["article"] * 5 + ["orphan"] * 2 + ["article"] * 2
    assert [r["article_seq"] for r in rows] == [0, 1, 1, 1, 1, 2, 2, 2, 3, 3]
    assert [(r["number"], r["base"]) for r in L.articles(found).orderBy("article_seq").collect()] == [("1o", 1), ("2Bis", 2), ("3", 3)]
    assert [str(r["date"]) for r in L.amendments(found).collect()] == ["2020-02-01"]
    counts = L.structure_counts(found).first()
    assert (counts["articles"], counts["fractions"], counts["subsections"], counts["amendments"]) == (3, 1, 1, 1)
    assert "*Párrafo adicionado DOF 01-02-2020*" in L.rebuild_document(found).first()["text"]
    assert one(spark, "Según el Lic. Pérez. Nuevo párrafo", L.format_paragraphs) == "Según el Lic. Pérez.\n\nNuevo párrafo"


def test_pages_with_tables_and_images(spark):
    from pagemill.sources.ocr import RESPONSE, explode_images, explode_pages

    image = {"id": "i1", "image_base64": "data:image/png;base64,iVBORw==", "annotation": {"image_type": "plot", "short_description": "curva"}}
    pages = [{"markdown": "[tbl-12.html](tbl-12.html) y tbl-5.html tbl-99.html", "header": "H", "tables": [{"content": "<table>5</table>"}, {"content": "<table>12</table>"}], "images": []}, {"markdown": "![i1](i1) fin", "tables": [], "images": [image]}]
    frame = explode_pages(spark.createDataFrame([("d", pages), ("e", None)], RESPONSE))
    assert frame.count() == 3
    text = {r["doc_id"]: r["text"] for r in A.assemble_markdown(frame, embed=True).collect()}["d"]
    assert text.startswith("**Encabezado:** H\n\n") and text.index("<table>12</table>") < text.index("<table>5</table>") and "tbl-99.html" in text
    assert "![i1](data:image/png;base64,iVBORw==)\n\n*plot*: curva fin" in text
    assert explode_images(frame).first()["image_key"] == "i1"
    plain = {r["doc_id"]: r["text"] for r in A.assemble_text(frame).collect()}["d"]
    assert "=== PÁGINA 2 ===\n\n" in plain and "Imagen (plot): curva" in plain


def test_rules_in_another_engine(spark):
    """The whole profile by another engine of expressions, on the texts of a given table."""
    import regex

    from pagemill.plans import views as V

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")

    def slow(text):
        for pattern, replacement in R.profile_rules():
            text = regex.sub(pattern, regex.sub(r"\$(\d)", r"\\g<\1>", replacement), text)
        return text

    docs = V.noisy(spark, folder).select("text").where("text is not null")
    marked = F.concat("text", F.lit(" rn cl. vvii Il lI nn eI la5 de7 el3 5l5 5O5 ¦§¢ ARTICULO CAP iTULO I V V I 1/2 <= != ''x'' 'y' --- __ (a\nb) a5 5a .A"))
    for r in docs.select(marked.alias("t"), R.optimize_text(marked).alias("found")).collect():
        assert r["found"] == slow(r["t"])


def test_tables_in_capitals_are_kept(spark):
    text = "uno ,dos\n<TABLE a='1'>\nrn ,x</Table> rn\n<tablero ,x"
    assert one(spark, text, R.optimize_markdown) == "uno, dos\n<TABLE a='1'>\nrn ,x</Table> m\n<tablero, x"


def test_long_words_and_many_hits_end(spark):
    word = "ab" * 500_000
    assert one(spark, f"{word} docu-\nmento a-\nb-\nc", R.fix_hyphenation) == f"{word} documento ab-\nc"
    docs = spark.createDataFrame([(1, "x rn y 1/2 " * 50_000)], "doc_id int, text string")
    row = D.gated_rules(docs, rules=[R.LETTER_PAIRS[0], ("1/2", "½")]).select(F.size("hits").alias("n"), F.element_at("hits", -1).alias("last"), F.md5("repaired").alias("t")).first()
    assert row.n == 100_000 and row.last.position == 10 * 50_000 - 4
    assert row.t == spark.createDataFrame([("x m y ½ " * 50_000,)], "t string").select(F.md5("t")).first()[0]


def test_positions_are_in_what_the_rule_sees(spark):
    row = D.gated_rules(spark.createDataFrame([("rn rn 1/2 rn",), (None,)], "text string"), rules=[R.LETTER_PAIRS[0], ("1/2", "½")]).collect()
    assert [(h.rule, h.position) for h in row[0].hits] == [(0, 0), (0, 3), (0, 10), (1, 4)] and row[0].repaired == "m m ½ m"
    assert row[1].repaired is None and row[1].hits == []


def test_entities_as_python_decodes_them(spark):
    rng = random.Random(6)
    names = rng.sample(sorted(html.entities.html5), 300)
    texts = [f"x &{n} y&{n};z &amp{n} &#{rng.randrange(1200)}; &#x{rng.randrange(70000):x} no" for n in names] + ["plain", "", "&", "&notit; &no"]
    rows = spark.createDataFrame([*enumerate(texts)], "k int, text string").select("k", R.unescape(F.array("text"))[0].alias("t")).collect()
    assert {r.k: r.t for r in rows} == {k: html.unescape(t) for k, t in enumerate(texts)}


def test_decomposed_laws_are_composed(spark):
    docs = spark.createDataFrame([(1, "Arti\u0301culo 1.- uno\r\nPa\u0301rrafo adicionado DOF 01-02-2020\n2 de 365"), (2, None)], "doc_id int, text string")
    (row,) = L.structure_counts(L.with_structure(L.legal_lines(docs))).collect()
    assert (row.articles, row.amendments) == (1, 1)
    assert one(spark, "e\u0301 a", composed) == "\u00e9 a" and one(spark, "abc", composed) == "abc"


def test_vocabulary_by_a_sent_and_by_a_joined_dictionary(spark):
    docs = spark.createDataFrame([(1, "Casa casa rn x"), (2, "perro"), (2, "CASA"), (3, ""), (4, None)], "doc_id long, text string")
    words = spark.createDataFrame([("casa",), ("casa",), ("x",), (None,)], "word string")
    sent, joined = D.vocabulary_validity(docs, words), D.vocabulary_validity(docs, words, sent=2)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect())) == [(1, 4, 2, 0.5), (2, 2, 1, 0.5)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(sent) and "SortMergeJoin" not in plan(sent)
    assert "SortMergeJoin" in plan(joined)


def test_rules_begin_with_what_they_replace_and_match_as_plain_ones(spark):
    assert not [p for p, _ in R.profile_rules() if p.startswith(("(?<", r"(?:\G", "(?="))]
    w = r"[\p{L}\p{N}_]"
    plain = [(rf"(?:\G|(?<!{w}))({w}++)-\s*[\r\n]+\s*([a-záéíóúüñ])", "$1$2"), (" +", " "), (rf"(?<!{w})l(?=\d)", "1"), (r"(?<=\d)O(?=\d)", "0"), (rf"(?<!{w})I\s+I(?!{w})", "II"), (rf"(?<={w})l(?=[A-Z])", "I"), (r"\n([^()\n]+)\)", "\n($1)")]
    fast = [R.HYPHENATION[0], R.SPACING[0], R.LETTERS_AND_DIGITS[0], R.LETTERS_AND_DIGITS[1], R.ROMANS[0], R.CASES[0], R.PAIRS[3]]
    rng = random.Random(3)
    texts = ["".join(rng.choice([*"lIO1 -\n\r.()ab_é", "-\n", "-\na-\nb", " I I ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for a, b in zip(plain, fast, strict=True):
        assert docs.where(F.regexp_replace("text", *a) != F.regexp_replace("text", *b)).isEmpty(), b
