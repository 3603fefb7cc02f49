"""Which skills' words a question has: all words and phrases of all skills at once.

A vocabulary is a table (skill_id, term, match, use). ``word`` terms count between characters that
are no letters or digits, ``phrase`` and ``stem`` terms anywhere, whatever the case. One automaton of
all terms reads each text once. ``use`` is ``route``, ``suggest`` or ``both``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of the largest vocabulary; it is a parameter that people write, and goes to every task.
MOST_ENTRIES = 100_000
ROUTE, SUGGEST = ("route", "both"), ("suggest", "both")

# The words of two built-in skills by use, in their order.
REDACTION = {
    "both": (
        "redact", "redaction", "anonymize", "anonymise", "anonymized", "anonymised", "remove personal data", "mask personal data",
        "anonymisieren", "anonymisierung", "anonymisiere", "pseudonymisieren", "schwärzen", "schwärzung", "schwärze", "geschwärzt", "personenbezogene daten", "personenbezogene daten entfernen",
    ),
    "suggest": ("sensitive data", "sensible daten"),
}
EDIT = {
    "both": ("find and replace", "search and replace", "replace all", "replace every", "rename", "suchen und ersetzen", "ersetzen", "ersetze", "umbenennen"),
    "route": ("replace", "change all", "change every", "substitute", "swap", "correct every", "austauschen", "ändere", "ändern", "durchgängig ersetzen", "ersetze durch"),
}


def match_of(term: str) -> str:
    """How a term counts if its entry doesn't say: one with white space as a phrase, any other as a word."""
    return "phrase" if any(c.isspace() for c in term) else "word"


def built_in(spark: SparkSession) -> DataFrame:
    """The entries of the built-in skills."""
    rows = [(skill, term, match_of(term), use) for skill, words in (("document-redaction", REDACTION), ("document-edit", EDIT)) for use, terms in words.items() for term in terms]
    return spark.createDataFrame(rows, "skill_id string, term string, match string, use string")


def hits(questions: DataFrame, entries: DataFrame, uses: tuple[str, ...] = ROUTE) -> DataFrame:
    """Skills of which a question (question_id, question) has a term: (question_id, skill_id, terms), ``terms`` in order.

    Null questions and terms have nothing; repeated entries count once; rows of one id each have their own.
    """
    wanted = entries.where(F.col("use").isin(*uses) & (F.trim("term") != "")).select("skill_id", F.lower("term").alias("term"), F.coalesce("match", F.lit("word")).alias("match")).distinct()
    rows = wanted.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary has {MOST_ENTRIES} entries at most")
    owners: dict[str, list[tuple[str, bool]]] = {}
    for r in sorted(rows):
        owners.setdefault(r.term, []).append((r.skill_id, r.match == "word"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in owners:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for frame in frames:
            out = []
            for key, question in zip(frame.question_id, frame.question, strict=True):
                text, found = (question or "").lower(), {}
                for end, term in automaton.iter(text):
                    begin = end + 1 - len(term)
                    alone = not text[begin - 1 : begin].isalnum() if begin else True
                    alone = alone and not text[end + 1 : end + 2].isalnum()
                    for skill, word in owners[term]:
                        if alone or not word:
                            found.setdefault(skill, set()).add(term)
                out += [(key, skill, sorted(terms)) for skill, terms in sorted(found.items())]
            yield pd.DataFrame(out, columns=["question_id", "skill_id", "terms"])

    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, skill_id string, terms array<string>"
    if not owners:
        return questions.sparkSession.createDataFrame([], schema)
    return questions.select("question_id", "question").mapInPandas(run, schema)
