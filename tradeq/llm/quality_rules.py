"""Line-first cleaning: every line is judged alone, failing lines go, and a document that loses too much is rejected.

Rules of a line (a line without words is neither judged nor removed):

* symbols: more than 3 of ``#*$%&|<>`` per 10 words;
* navigation: two or more separators standing alone as words, at least one per 5 words;
* capitals: 10 letters or more of which 80 % are capitals;
* punctuation: no word ends a sentence, or fewer than 10 words and the line does not end one;
* boilerplate: one of the phrases below, whatever the case of A-Z.

Null text is empty: no words, ``base_failed``, not kept. Equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tradeq.llm.common import hashes, runs, slices, texts

SYMBOLS = "#*$%&|<>"
# Separators and phrases of page furniture.
SEPARATORS = ("|", "»", "«", "›", "·", "•", "/", ">", "<")
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "sign up", "log in", "subscribe to", "share this", "javascript", "copyright", "©", "licensed under", "released under",
)
#: A document is rejected if more than this share of its words stood in removed lines.
MOST_LOST = 30

SPACE = " \t-\r"
SENTENCE_END = rf"""[.!?…:;。！？]["'”’»)\]]*"""
ENDS_WORD = regex.compile(rf"{SENTENCE_END}(?:[{SPACE}]|\Z)")
ENDS_LINE = regex.compile(rf"{SENTENCE_END}[{SPACE}]*\Z")
ANY_PHRASE = regex.compile("|".join(map(regex.escape, PHRASES)))
CAPITAL, LETTER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}")
LOWER_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SPACES = tuple(" \t\n\x0b\x0c\r")


def fails(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line breaks, of a line with words."""
    n = len(words)
    if 10 * sum(map(line.count, SYMBOLS)) > 3 * n:
        return "symbols"
    bars = sum(map(words.count, _SEPARATORS))
    if bars >= 2 and 5 * bars >= n:
        return "navigation"
    capitals = len(CAPITAL.findall(line))
    if capitals >= 8:
        letters = len(LETTER.findall(line))
        if letters >= 10 and 10 * capitals >= 8 * letters:
            return "capitals"
    if not ENDS_LINE.search(line) and (n < 10 or not ENDS_WORD.search(line)):
        return "punctuation"
    if ANY_PHRASE.search(line.translate(LOWER_ASCII)):
        return "boilerplate"
    return None


_SEPARATORS = [s.encode() for s in SEPARATORS]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    h = runs(hashes(words), 3)
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : i + len(h)] |= twice
    return int(inside.sum())


def judge(text: str) -> tuple:
    """The counts and the cleaned text of one document."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    seen: set[str] = set()
    dup = lost = removed = 0
    kept = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if fails(line, own):
                lost += len(own)
                removed += 1
                continue
        kept.append(line)
    repeat = repeated_words(words)
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    return (
        n_words,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat,
        failed,
        not failed and 100 * lost <= MOST_LOST * n_words,
        removed,
        lost,
        "\n".join(kept),
    )


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_lines_removed long, n_words_removed long"
)


def clean(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Counts, verdict and, with ``with_text``, ``text_clean`` (the lines that pass) of every whole text; no shuffle."""
    plain = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, {FIELDS}" + ", text_clean string" * with_text
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            columns = list(zip(*[judge(t) for t in texts(batch, "t")]))
            arrays = [pa.array(c, pa.bool_() if isinstance(c[0], bool) else pa.int64()) for c in columns[:-1]]
            if with_text:
                arrays.append(pa.array(columns[-1], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), *arrays], names=names)

    return plain.mapInArrow(run, schema).withColumnRenamed("k", key)
