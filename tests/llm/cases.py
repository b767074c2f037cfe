"""Small tables with every awkward row."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = {
    "en": "the of and to in that it for on was river stone garden window silver morning walked quietly towards evening".split(),
    "fr": "de la le et les des en un une que maison fenêtre rivière matin jardin pierre lentement soir était".split(),
    "de": "der die und in den von zu das mit sich Straße Fenster Morgen Garten Stein langsam Abend über größer".split(),
}
#: columns that operators might use inside themselves
CLASHING = ["key", "counts", "accepted", "found", "predicted", "signature", "gone_id", "again_id", "tokens", "n", "bucket", "class_distance", "rank_of_row", "found_language", "found_entities", "rep", "first", "slot", "a.b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, lang: str = "en", n: int = 60) -> str:
    """Invented sentences of a language."""
    r = random.Random(seed)
    words = [r.choice(WORDS[lang]) for _ in range(n)]
    return " ".join(w.capitalize() + "" if k % 9 == 0 else w + "." * (k % 9 == 8) for k, w in enumerate(words))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """A table of documents; extra adds columns of clashing names."""
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    schema = DOCS + ", " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}-{k}" if k % 2 else None for c in CLASHING)) for k, r in enumerate(rows)], schema)


def awkward() -> list[tuple]:
    """Nulls in every column, empty, very short and very long texts, copies, near copies, ties, repeated rows, odd characters."""
    a, b = prose(1), prose(2)
    long = " ".join(prose(k, n=400) for k in range(60))
    return [
        row(1, a), row(2, a), row(3, a.replace("river", "lake", 1)), row(4, b), row(4, b), row(4, prose(3)),
        row(None, prose(4)), row(None, None), row(5, None), row(6, ""), row(7, "   \n "), row(8, "!!! ??? 12 34"),
        row(9, "one"), row(10, "one"), row(11, long), row(12, prose(5, "fr"), "fr"), row(13, prose(6, "de"), "de"), row(14, prose(7), None),
        row(15, prose(8), "xx", None), (16, prose(9), "en", None, None), row(17, "Write to ana.12@mail3.example.com or 10.1.2.3 now. " + prose(10)),
        row(18, "🙂 \x00 naïve   x́ " + prose(11)), row(-5, prose(12)), row(2**60, prose(13)),
    ]
