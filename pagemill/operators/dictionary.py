"""Dictionary-gated repair, correction hits and vocabulary checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.repair import OCR_RULES, load_rules
from pagemill.functions.text import tokens

# Common Spanish words.
SPANISH = """
el la los las un una unos unas de del a al en con por para sin sobre es son está están hay tiene tienen hace ser estar
haber tener hacer poder decir ir ver dar saber querer llegar pasar yo tú él ella nosotros vosotros ellos ellas me te se
nos os le lo mi tu su nuestro vuestro este ese aquel esta esa aquella persona año día tiempo caso parte forma problema
mano lugar país momento vez vida mundo hombre mujer hijo casa trabajo grande pequeño bueno malo nuevo viejo primero
último otro mismo todo alguno ninguno muy más menos también tampoco siempre nunca bien mal ahora aquí allí después antes
y o pero porque que si como cuando artículo página número documento archivo texto imagen tabla dato información sistema
proceso
""".split()


def load_dictionary(spark: SparkSession, path: str | None = None, lang: str = "es") -> DataFrame:
    """`lang, word`: the built-in Spanish list, or the words of a text file, one a line."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")) if path else spark.createDataFrame([(w,) for w in SPANISH], "word string")
    return words.where("word <> ''").select(F.lit(lang).alias("lang"), "word").distinct()


def is_valid_word(word: Column, dictionary: Iterable[str] = SPANISH) -> Column:
    """Whether a word has two letters or more and its lower case is in a small dictionary."""
    return (F.length(word) >= 2) & F.lower(word).isin(list(dictionary))


def dictionary_lookup(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds `valid` to rows with a `word`. The dictionary may be of any size: each distinct word is looked up once."""
    known = words.select(F.lower("word").alias("low")).distinct().hint("merge").join(dictionary.select(F.col("word").alias("low")).distinct().hint("merge"), "low")
    found = words.withColumn("low", F.lower("word")).hint("merge").join(known.withColumn("known", F.lit(True)).hint("merge"), "low", "left")
    return found.select(*words.columns, (F.coalesce("known", F.lit(False)) & (F.length("word") >= 2)).alias("valid"))


#: Up to so many distinct words, a dictionary is sent to all tasks.
SENT_WORDS = 200_000


def vocabulary_validity(docs: DataFrame, dictionary: DataFrame, sent: int = SENT_WORDS) -> DataFrame:
    """`doc_id, n_words, n_valid, validity`: how many of a document's words a dictionary has.

    A dictionary of up to `sent` words, which are counted first, is sent to all tasks, so that no word of a document is
    shuffled. A larger one is joined by word, with a document's words counted before the join.
    """
    known = dictionary.select("word").distinct().withColumn("known", F.lit(1))
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("word")).select("doc_id", F.lower("word").alias("word"))
    if known.limit(sent + 1).count() <= sent:
        counts = words.withColumn("n", F.lit(1)).join(known.hint("broadcast"), "word", "left")
    else:
        counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).hint("merge").join(known.hint("merge"), "word", "left")
    found = counts.withColumn("ok", F.col("known").isNotNull() & (F.length("word") >= 2))
    found = found.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n_valid"))
    return found.withColumn("validity", F.col("n_valid") / F.col("n_words"))


_HITS = "array<struct<rule:int,original:string,corrected:string,position:int,applied:boolean>>"


class _Gate:
    """Rules compiled once for a task, and what a dictionary holds back."""

    def __init__(self, rules: list[tuple[str, str]], words: Iterable[str]):
        import regex

        group = re.compile(r"\$(\d)")
        self._rules = [(k, regex.compile(p), group.sub(r"\\g<\1>", r.replace("\\", "\\\\"))) for k, (p, r) in enumerate(rules)]
        self._words = frozenset(words)

    def __call__(self, text: str) -> tuple[str, list[dict]]:
        hits: list[dict] = []
        for number, pattern, template in self._rules:
            parts, last = [], 0
            for m in pattern.finditer(text):
                old = m[0]
                new = pattern.sub(template, old)
                use = new != old and not (len(old) >= 2 and old.lower() in self._words)
                hits.append({"rule": number, "original": old, "corrected": new, "position": m.start(), "applied": use})
                parts += (text[last : m.start()], new if use else old)
                last = m.end()
            if parts:
                text = "".join(parts) + text[last:]
        return text, hits


def gated_rules(df: DataFrame, text: str = "text", rules: Iterable = OCR_RULES, dictionary: Iterable[str] = SPANISH, name: str = "repaired", hits: str = "hits") -> DataFrame:
    """Adds the text after the rules that the dictionary lets pass, and the array of all hits.

    A hit is `rule, original, corrected, position, applied`. It is applied if the rule changes it by itself and it isn't
    a word as it stands. Rule k sees what rule k - 1 left, and positions are in that text. A rule's hits are found in one
    pass and its parts joined once, so work grows with the text and its hits. This is a small function over Arrow batches:
    56 rules with arrays in lambdas take Spark's analyzer longer than their work takes. A null text stays null, without hits.
    """
    rules, words = load_rules(rules), list(dictionary)
    kept = [f for f in df.schema.fields if f.name not in (name, hits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _Gate(rules, words)
        kind = pa.list_(pa.struct([("rule", pa.int32()), ("original", pa.string()), ("corrected", pa.string()), ("position", pa.int32()), ("applied", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [(None, []) if t is None else gate(t) for t in part.column(text).to_pylist()]
                columns = [*[part.column(f.name) for f in kept], pa.array([t for t, _ in done], pa.string()), pa.array([h for _, h in done], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], name, hits])

    added = T.StructType.fromDDL(f"`{name}` string, `{hits}` {_HITS}")
    return df.mapInArrow(run, T.StructType([*kept, *added.fields]))


def correction_hits(df: DataFrame, rules: Iterable = OCR_RULES, dictionary: Iterable[str] = SPANISH) -> DataFrame:
    """`doc_id` with a row for each hit of the rules in `text`."""
    return gated_rules(df.select("doc_id", "text"), rules=rules, dictionary=dictionary).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def correction_stats(hits: DataFrame, *groups: str) -> DataFrame:
    """How many hits of each rule were applied and skipped."""
    return hits.groupBy(*groups, "rule").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"))
