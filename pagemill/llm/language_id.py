"""Language identification by word frequencies, with back-off to character n-grams.

A learned word gives each language the logarithm of its relative frequency there. A word that wasn't learned falls back to
its longest character n-grams that were: n-grams of 4 characters, else of 3, 2 and 1, of which it takes the mean. A text's
score adds those of its words, and is made a share of the evidence over all learned languages.

Counts are taken over all labelled texts, and all are kept, smoothed by half an occurrence. What a word or n-gram adds to
the languages that have it is a list as long as those; what it adds to the others depends on the language only and is
added once a text. So a model is two written tables, whose size goes with the counts and not with words times languages.
Scoring looks up the words of texts by joins. The most frequent words are also held by the tasks, `HELD` entries of a word
and a language in all, so that only the other words need a row; that bounds what a task holds and changes no score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import small, written

#: Runs of letters and of numbers that aren't digits; the latter are looked for in distinct words only.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
COUNTED = 150_000  # entries that a counting task holds before it hands them on
HELD = 400_000
LONGEST = 4  # characters of an n-gram
_PAD = "\0"  # no letter
_SCORES = "array<struct<key:int,w:double>>"


@dataclass
class LanguageModel:
    """What learned words (`word, scores`) and n-grams (`size, gram, scores`) add to languages, by number.

    `base[n]` is what any n-gram adds to each language, and `base[0]` any word. `held` numbers the words that tasks hold;
    the entries of number k are `entries[starts[k]:starts[k + 1]]`, and `weights` there.
    """

    languages: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    base: list[list[float]] = field(default_factory=list)
    held: dict[str, int] = field(default_factory=dict)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def word_counts(text: str) -> Counter:
    """How often a text has each of its runs of letters, in lower case."""
    found = Counter(WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def held_out() -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 4, is 2. A null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _word_counts(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """`word, lang, n`: how often each language's texts have the word."""
    numbers = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(numbers[lang], w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            lang, word, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in small(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(word_counts(text))
                if sum(map(len, held.values())) > COUNTED:
                    yield out()
        if any(held.values()):
            yield out()

    return labelled.mapInArrow(count, "lang int, word string, n long").repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _scored(counts: DataFrame, *keys: str) -> DataFrame:
    """`scores`: how much more each language that has the key gets than one that doesn't; and `n`, how often all have it."""
    entry = F.struct(F.col("lang").alias("key"), F.log(2 * F.col("n") + 1).alias("w"))  # log(n + 1/2) - log(1/2)
    return counts.groupBy(*keys).agg(F.collect_list(entry).alias("scores"), F.sum("n").alias("n"))


def _bases(counts: DataFrame, languages: int) -> list[float]:
    """What a key that a language lacks gives it: log(1/2) less the log of the smoothed total."""
    totals = {r["lang"]: (r["total"], r["keys"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("keys")).collect()}
    return [math.log(0.5) - math.log(total + 0.5 * (keys + 1)) for total, keys in (totals.get(k, (0, 0)) for k in range(languages))]


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words with `most` entries in all: those from a class of frequency on."""
    at = F.floor(F.log2(F.col("n")) * 8).cast("int")
    classes = words.groupBy(at.alias("at")).agg(F.sum(F.size("scores")).alias("entries")).collect()  # some hundred
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r["at"]):
        total += r["entries"]
        if total > most:
            break
        least = r["at"]
    return words.where(at >= least if least is not None else F.lit(False))


def train(docs: DataFrame, held: int = HELD) -> LanguageModel:
    """A model of `text, lang`; rows with a null in either are left out. Without any, the model knows no language."""
    labelled = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([])
    counts = written(_word_counts(labelled, languages), "word-counts")
    words = written(_scored(counts, "word"), "word-scores")
    table = _frequent(words, held).select("word", "scores").toArrow()
    scores = table["scores"].combine_chunks()
    flat = scores.flatten()
    # each start of an n-gram of any size is that of one of the longest size, which ends in padding near a word's end
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" " + _PAD * (LONGEST - 1)))
    starts = F.transform(F.sequence(F.lit(1), F.length("word") + 2), lambda k: F.substring(marked, k, F.lit(LONGEST)))
    longest = counts.select(F.explode(starts).alias("gram"), "lang", "n").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    of = F.filter(F.array(*[F.struct(F.lit(n).alias("size"), F.substring("gram", 1, n).alias("gram")) for n in range(1, LONGEST + 1)]), lambda g: ~F.contains(g["gram"], F.lit(_PAD)))
    grams = written(longest.select(F.explode(of).alias("g"), "lang", "n").groupBy("g.size", "g.gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    base = [_bases(counts, len(languages)), *(_bases(grams.where(F.col("size") == n), len(languages)) for n in range(1, LONGEST + 1))]
    return LanguageModel(
        languages,
        words,
        written(_scored(grams, "size", "gram"), "gram-scores"),
        base,
        {w: k for k, w in enumerate(table["word"].to_pylist())},
        np.append(0, np.cumsum(scores.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64),
        flat.field("key").to_numpy(zero_copy_only=False).astype(np.int64),
        flat.field("w").to_numpy(zero_copy_only=False),
    )


def _level(n: int) -> int:
    """The key under which the number of n-grams, or of words (0), goes with the scores."""
    return -1 - n


def _unlearned_scores(words: DataFrame, model: LanguageModel) -> DataFrame:
    """`word, scores` of distinct words that weren't learned: the mean over their longest n-grams that were. Without any it has no row."""
    done, left = [], words
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    for n in range(LONGEST, 0, -1):
        cut = F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda k: F.substring(marked, k, F.lit(n)))  # noqa: B023
        grams = left.where(F.length(marked) >= n).select("word", F.explode(cut).alias("gram"))
        known = grams.hint("merge").join(model.grams.where(F.col("size") == n).select("gram", "scores"), "gram")
        entries = known.select("word", F.explode(F.concat("scores", F.array(F.struct(F.lit(_level(n)).alias("key"), F.lit(1.0).alias("w"))))).alias("e"))
        sums = entries.groupBy("word", "e.key").agg(F.sum("e.w").alias("w")).groupBy("word").agg(F.collect_list(F.struct("key", "w")).alias("scores"))
        count = F.element_at(F.filter("scores", lambda e: e["key"] == _level(n)), 1)["w"]  # noqa: B023
        found = written(sums.select("word", F.transform("scores", lambda e: F.struct(e["key"].alias("key"), (e["w"] / count).alias("w"))).alias("scores")), "unlearned-words")  # noqa: B023
        done.append(found)
        left = written(left.hint("merge").join(found.select("word"), "word", "left_anti"), "words-left")
    return reduce(DataFrame.unionByName, done)


def _text_id(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _facts(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Of each distinct text the number of its words, what the held ones add to each language, and its other words with counts."""
    languages = len(model.languages)
    shared = docs.sparkSession.sparkContext.broadcast((model.held, model.starts, model.entries, model.weights, np.array(model.base[0])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, entries, weights, base = shared.value
        for batch in small(batches, max(1, min(1000, 4_000_000 // languages))):
            sizes, others, times = [], [], []
            owner: list[int] = []
            known: list[int] = []
            often: list[int] = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = word_counts(text)
                sizes.append(words.total())
                others.append([])
                times.append([])
                for w, n in words.items():
                    at = held.get(w)
                    if at is None:
                        others[k].append(w)
                        times[k].append(n)
                    else:
                        owner.append(k)
                        known.append(at)
                        often.append(n)
            at, of, n = np.array(known, np.int64), np.array(owner, np.int64), np.array(often, float)
            lengths = starts[at + 1] - starts[at]
            place = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            sums = np.bincount(np.repeat(of, lengths) * languages + entries[place], np.repeat(n, lengths) * weights[place], len(sizes) * languages).astype(float).reshape(-1, languages)
            sums += np.bincount(of, n, len(sizes))[:, None] * base
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, languages, dtype=np.int32), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array(sizes, pa.int64()), lists, pa.array(others, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["text_id", "size", "sums", "others", "times"])

    found = docs.select(_text_id(F.col("text")).alias("text_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = found.mapInArrow(count, "text_id long, size long, sums array<double>, others array<string>, times array<long>")
    return written(found.dropDuplicates(["text_id"]), "texts")


def _other_sums(facts: DataFrame, model: LanguageModel) -> DataFrame:
    """`text_id, others`: a map of what the words that tasks don't hold add, by language and by level."""
    rows = facts.select("text_id", F.explode(F.arrays_zip("others", "times")).alias("x")).select("text_id", F.col("x.others").alias("word"), F.col("x.times").alias("n"))
    one = F.array(F.struct(F.lit(_level(0)).alias("key"), F.lit(1.0).alias("w")))
    learned = model.words.select("word", F.concat("scores", one).alias("scores"))
    rows = written(rows.hint("merge").join(learned, "word", "left").select("text_id", F.when(F.col("scores").isNull(), F.col("word")).alias("word"), "n", "scores"), "other-words")
    unlearned = rows.where("word is not null").select("text_id", "word", "n")
    scores = _unlearned_scores(written(unlearned.select("word").distinct(), "unlearned"), model)
    both = rows.where("word is null").select("text_id", "n", "scores").unionByName(unlearned.hint("merge").join(scores, "word").select("text_id", "n", "scores"))
    entries = both.select("text_id", "n", F.explode("scores").alias("e"))
    sums = entries.groupBy("text_id", "e.key").agg(F.sum(F.col("n") * F.col("e.w")).alias("w"))
    return sums.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("others"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds `lang_pred` and `score` to rows with a `text`: the likeliest learned language and its share of the evidence.

    A text that is null or has no letter gets `und` and 0, and so does every text if no language was learned. Of equally
    likely languages the first by name is taken. Columns of these two names are replaced; all others stay, and only
    `text` is read.
    """
    docs = docs.drop("lang_pred", "score")
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    facts = _facts(docs, model)
    total = facts.select("text_id", "size", "sums").hint("merge").join(_other_sums(facts, model), "text_id", "left").where("size > 0")
    at = lambda k: F.coalesce(F.try_element_at("others", k), F.lit(0.0))
    numbers = lambda xs: F.split(F.lit(" ".join(map(repr, xs))), " ").cast("array<double>")
    added = lambda x, k: reduce(lambda a, n: a + at(F.lit(_level(n))) * F.get(numbers(model.base[n]), k), range(LONGEST + 1), x + at(k))
    # neighbouring words aren't independent
    total = total.select("text_id", F.transform("sums", lambda x, k: added(x, k) / F.sqrt("size")).alias("total"))
    most = F.array_max("total")
    best = F.array_position("total", most).cast("int")
    odds = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    names = F.array(*[F.lit(x) for x in model.languages])
    told = written(total.select(F.col("text_id").alias("\nid"), F.element_at(names, best).alias("\npred"), (1 / odds).alias("\nscore")), "languages")
    joined = docs.withColumn("\ntext id", F.when(F.col("text").isNotNull(), _text_id(F.col("text"))))
    joined = joined.hint("merge").join(told, F.col("\ntext id") == F.col("\nid"), "left")
    return joined.select(*docs.columns, F.coalesce("\npred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("\nscore", F.lit(0.0)).alias("score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
