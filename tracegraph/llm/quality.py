"""Operator 2, quality by distribution divergence.

Two histograms of a document are held against those of its language: characters by class, and the
WORDS most common words of the language (all other words are one more bin). Both the common words and the references are counted over all documents of
the declared language that are long enough, as whole numbers. The measure is the Jensen-Shannon
distance (base 2, so 0 to 1). A document is rejected when a distance is over its limit; a histogram of fewer than
MIN_CHARS characters (digits, which may be anything, left out) or MIN_WORDS words is not judged, as its distance would be noise.

The limit of word distances is MAX_WORD_DISTANCE and what chance alone gives: n words drawn from the reference itself are, squared, about
WORDS / (8 n ln 2) away from it, and MARGIN times the root of that is allowed. A text of few words without any common one is thus
within its limit until n is about 75. MAX_CLASS_DISTANCE and MAX_WORD_DISTANCE are parameters.

Counting takes a table look-up for each character and one scan for words, in Arrow batches: one pass adds up the languages' counts in each task, one judges. Sums and distances are
built-in expressions. References, one row for each language, are broadcast if there are at most MOST_BROADCAST, and joined otherwise.

Defined results: null, empty and short texts are not judged (distances null) and accepted; documents without a language, or of one that no other document has, are
a language of their own; one without a long enough document has no reference and its documents are not judged; of words as common the smaller is in a bin; a distance at its limit is accepted;
very long texts are counted whole; null doc_ids stay null; rows that repeat are judged alike; other columns are not read (the filter keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import codes, fresh, give_back, importable, settle, trimmed

CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "space": r" \t\r\n", "stop": r".,;:?'", "layout": r"|<>{}\[\]_\\~^"}  #: and a last class, anything else but digits
DIGITS = r"\p{N}"
WORDS = 20  #: common words of a language
MIN_CHARS, MIN_WORDS = 100, 30
MAX_CLASS_DISTANCE = 0.175
MAX_WORD_DISTANCE, MARGIN = 0.13, 1.16
WORD_NOISE = MARGIN * math.sqrt(WORDS / (8 * math.log(2)))  #: over the root of the number of words
MOST_BROADCAST = 10_000  #: languages
MOST_HELD = 60_000  #: words that a task counts before it passes them on


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Class of each code point; stop characters and white space are ASCII, the rest goes by Unicode category."""
    table = np.full(0x110000, len(CLASSES), dtype=np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c == "Ll" or c == "Lu" or c[0] == "N":
            table[i] = {"Ll": 0, "Lu": 1}.get(c, len(CLASSES) + 1)
    for k, own in ((2, " \t\r\n"), (3, ".,;:?'"), (4, "|<>{}[]_\\~^")):
        table[[ord(x) for x in own]] = k
    return table


WORD = re.compile(r"[^\W\d_]+")


def class_counts(text: str) -> np.ndarray:
    """Characters by class, without digits."""
    return np.bincount(_class_table()[codes(text)], minlength=len(CLASSES) + 2)[:-1]


def words(text: str) -> Counter:
    """Words, in lower case, and how often each occurs."""
    return Counter(WORD.findall(text.lower()))


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, text) to (key, word, n) added up over long enough texts; the classes are words of one digit."""
    held: dict[str, Counter] = {}
    for pdf in batches:
        for key, text in zip(pdf["key"], pdf["text"]):
            classes = class_counts(text)
            if classes.sum() >= MIN_CHARS:
                found = words(text)
                if found.total() >= MIN_WORDS:
                    own = held.setdefault(key, Counter())
                    own.update(found)
                    own.update({str(k): n for k, n in enumerate(classes.tolist())})
        if sum(map(len, held.values())) > MOST_HELD:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _rows(held: dict[str, Counter]) -> pd.DataFrame:
    return pd.DataFrame([(k, w, n) for k, own in held.items() for w, n in own.items()], columns=["key", "word", "n"])


def _histograms(texts: pd.Series, vocabularies: pd.Series) -> pd.DataFrame:
    out = []
    for text, vocabulary in zip(texts, vocabularies):
        found = words(text)
        bins = [found[w] for w in (vocabulary if vocabulary is not None else ())]
        out.append((class_counts(text), [*bins, found.total() - sum(bins)]))
    give_back()
    return pd.DataFrame(out, columns=["classes", "words"])


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    n, m = total(counts), total(reference)

    def term(x: Column, y: Column) -> Column:
        p, q = x / n, y / m
        half = (p + q) / 2
        return F.when(p > 0, p * F.log(p / half)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log(q / half)).otherwise(F.lit(0.0))

    parts = F.zip_with(counts, reference, term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / (2 * math.log(2))))


def _key() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("?"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def references(docs: DataFrame) -> DataFrame:
    """(key, classes, vocabulary, words): for each language its counts by class, its common words, and their counts and that of all others."""
    importable(docs.sparkSession)
    counts = docs.select(_key().alias("key"), _text().alias("text")).mapInPandas(trimmed(_tallied), "key string, word string, n long")
    counts = settle(counts.groupBy("key", "word").agg(F.sum("n").alias("n")))
    is_class = F.col("word").rlike("^[0-9]$")
    ranked = counts.where(~is_class).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= WORDS)
    common = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    whole = counts.groupBy("key").agg(F.sum(F.when(~is_class, F.col("n"))).alias("total"), *[F.sum(F.when(F.col("word") == str(k), F.col("n"))).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    top = F.transform("top", lambda x: x["n"])
    rest = F.col("total") - F.aggregate(top, F.lit(0).cast("long"), lambda s, x: s + x)
    return settle(whole.join(common, "key").select("key", F.array(*[F.col(f"c{k}") for k in range(len(CLASSES) + 1)]).alias("classes"), F.transform("top", lambda x: x["word"]).alias("vocabulary"), F.concat(top, F.array(rest)).alias("words")))


def judged(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with added columns class_distance, word_distance and accepted, under the names that the dict gives."""
    refs = references(docs)
    names = {n: fresh(docs, n) for n in ("key", "counts", "class_distance", "word_distance", "accepted", "ref_classes", "ref_vocabulary", "ref_words")}
    few = refs.count() <= MOST_BROADCAST
    refs = refs.select(F.col("key").alias(names["key"]), *[F.col(n).alias(names[f"ref_{n}"]) for n in ("classes", "vocabulary", "words")])
    out = docs.withColumn(names["key"], _key()).join(F.broadcast(refs) if few else refs, names["key"], "left")
    out = out.withColumn(names["counts"], F.pandas_udf(_histograms, "classes array<long>, words array<long>")(_text(), F.col(names["ref_vocabulary"])))
    classes, words = F.col(names["counts"])["classes"], F.col(names["counts"])["words"]
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumns({
        names["class_distance"]: F.when(total(classes) >= MIN_CHARS, F.round(_distance(classes, F.col(names["ref_classes"])), 6)),
        names["word_distance"]: F.when(total(words) >= MIN_WORDS, F.round(_distance(words, F.col(names["ref_words"])), 6)),
    })
    far = lambda n, most: F.coalesce(F.col(names[n]) > most, F.lit(False))
    limit = MAX_WORD_DISTANCE + WORD_NOISE / F.sqrt(F.greatest(total(words), F.lit(1).cast("long")).cast("double"))
    return out.withColumn(names["accepted"], ~(far("class_distance", MAX_CLASS_DISTANCE) | far("word_distance", limit))), names


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, class_distance, word_distance, accepted) for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return judged(own)[0].select("doc_id", "lang", "class_distance", "word_distance", "accepted")


def keep_good(docs: DataFrame) -> DataFrame:
    """The accepted rows of docs, all columns."""
    out, names = judged(docs)
    return out.where(F.col(names["accepted"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    counted = ", ".join(f"length(text) - length(regexp_replace(text, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS c{k}" for k, c in enumerate(CLASSES.values()))
    n_classes = len(CLASSES) + 1

    def distance(name: str) -> str:
        p, q = f"({name}[i] / list_sum({name})::DOUBLE)", f"(r_{name}[i] / list_sum(r_{name})::DOUBLE)"
        half = f"(({p} + {q}) / 2)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({name}) + 1), lambda i: CASE WHEN {p} > 0 THEN {p} * ln({p} / {half}) ELSE 0.0 END + CASE WHEN {q} > 0 THEN {q} * ln({q} / {half}) ELSE 0.0 END)) / {2 * math.log(2)!r}))"

    return f"""
WITH d AS (SELECT doc_id, lang AS given, coalesce(lang, '?') AS lang, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, given, lang, length(regexp_replace(text, '[{DIGITS}]+', '', 'g')) AS chars, {counted},
  list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM d),
h AS (SELECT doc_id, given, lang, [{', '.join(f'c{k}' for k in range(n_classes - 1))}, chars - {' - '.join(f'c{k}' for k in range(n_classes - 1))}] AS classes, chars, len(ws) AS n, ws FROM k),
m AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(ws) AS w FROM h WHERE chars >= {MIN_CHARS} AND n >= {MIN_WORDS}) GROUP BY 1, 2),
v AS (SELECT lang, list(w ORDER BY rank) AS vocabulary, list(c ORDER BY rank) AS c FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS rank FROM m) WHERE rank <= {WORDS} GROUP BY lang),
s AS (SELECT lang, [{', '.join(f'sum(classes[{k}])' for k in range(1, n_classes + 1))}] AS r_classes, sum(n) AS r_n FROM h WHERE chars >= {MIN_CHARS} AND n >= {MIN_WORDS} GROUP BY lang),
f AS (SELECT doc_id, given, classes, chars, n, r_classes, list_concat(c, [r_n - list_sum(c)]) AS r_words, list_transform(vocabulary, lambda x: len(list_filter(ws, lambda w: w = x))) AS bins FROM h LEFT JOIN s USING (lang) LEFT JOIN v USING (lang)),
g AS (SELECT *, list_concat(bins, [n - list_sum(bins)]) AS words FROM f),
j AS (SELECT doc_id, given, chars, n, {distance('classes')} AS x, {distance('words')} AS y FROM g),
r AS (SELECT doc_id, given AS lang, n, CASE WHEN chars >= {MIN_CHARS} THEN round(x, 6) END AS class_distance, CASE WHEN n >= {MIN_WORDS} THEN round(y, 6) END AS word_distance FROM j)
SELECT doc_id, lang, class_distance, word_distance, NOT (coalesce(class_distance > {MAX_CLASS_DISTANCE}, false) OR coalesce(word_distance > {MAX_WORD_DISTANCE} + {WORD_NOISE!r} / sqrt(greatest(n, 1)), false)) AS accepted FROM r
"""


ORACLE = _oracle()
