"""English stems by Porter's algorithm (1980), and an index of stems.

A word is seen as consonants (c) and vowels (v); its measure is how often a run of vowels is
followed by a run of consonants. The rules are data: suffix, what replaces it, and what the
rest of the word must satisfy. Stems are made once for each distinct term of an Arrow batch.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators import fulltext

#: The algorithm's suffix tables.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_ASCII = re.compile(r"[a-z]+\Z")
_MEASURE = re.compile("v+c+")
_SHORT_END = re.compile("cvc\\Z")


def shape(word: str) -> str:
    """c or v for each letter; y is a consonant at the start and after a vowel."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    return len(_MEASURE.findall(shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("c")


def _short(word: str) -> bool:
    """Ends like 'hop': consonant, vowel, consonant that is not w, x or y."""
    return bool(_SHORT_END.search(shape(word))) and word[-1] not in "wxy"


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends with, or ''."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _past(word: str) -> str:
    """-ed and -ing, where a vowel is left, and what makes the rest a word again."""
    end = _ending(word, ("ed", "ing"))
    rest = word[: len(word) - len(end)]
    if not end or "v" not in shape(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short(rest) else rest


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and with other signs than a to z, stay."""
    if len(word) < 3 or not _ASCII.match(word):
        return word
    for end, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # plurals
        if word.endswith(end):
            word = word[: len(word) - len(end)] + by
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        word = _past(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _ending(word, table)
        if end and measure(word[: len(word) - len(end)]) > 0:
            word = word[: len(word) - len(end)] + table[end]
    end = _ending(word, STEP_4)
    rest = word[: len(word) - len(end)]
    if end and measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem(terms: pd.Series) -> pd.Series:
    """Stems of a column of terms."""
    codes, distinct = pd.factorize(terms)
    made = pd.Series([porter(t) for t in distinct] + [None])
    return made.take(codes).reset_index(drop=True)


def build_stemmed(index: fulltext.Index, path: str) -> fulltext.Index:
    """Write an index whose terms are the stems of another's, under path; a document's places of a stem are those of its terms."""
    spark = index.documents.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by ranges first: what has one stem and document is in one partition then, and is not sent again
    rows = index.postings.select(stem(F.col("term")).alias("term"), "doc_id", "tf", "positions").repartitionByRange(width, "term", "doc_id").groupBy("term", "doc_id")
    found = rows.agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    found.sortWithinPartitions("term", "doc_id").write.option("compression", "zstd").parquet(f"{path}/postings")
    index.documents.write.parquet(f"{path}/documents")
    return fulltext.Index.open(spark, path)


def stemmed(clauses: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """A query's clauses for an index of stems; prefixes stay as they are."""
    return [c if c[0] == "prefix" else (c[0], *[porter(w) for w in c[1:]]) for c in clauses]
