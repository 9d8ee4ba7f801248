"""Quality rules as weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.llm import common
from kinsheet.session import materialize

#: Characters that count as symbols. Fixed value.
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: ``(measure, good from, good to, bad below, bad above)``: a rule votes to keep inside the
#: first range, to drop outside the second, and abstains between.
RULES = [
    ("n_words", 80, 200_000, 50, 1_000_000),
    ("mean_word", 3.0, 10.0, 2.0, 14.0),
    ("symbols_a_word", 0.0, 0.02, 0.0, 0.1),
    ("symbol_runs_a_word", 0.0, 0.005, 0.0, 0.05),
    ("dup_line_share", 0.0, 0.5, 0.0, 0.7),
    ("repeated_share", 0.0, 0.15, 0.0, 0.4),
    ("letter_words", 0.9, 1.0, 0.7, 1.0),
    ("ended_lines", 0.5, 1.0, 0.1, 1.0),
    ("distinct_share", 0.2, 1.0, 0.1, 1.0),
    ("upper_share", 0.0, 0.25, 0.0, 0.4),
]
#: Votes added to each count, and the range of the share of good texts.
SMOOTH = 1.0
PRIOR = (0.02, 0.98)
ROUNDS, CLOSE = 200, 1e-9

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _distinct(owner: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Number of distinct values of each text."""
    size = int(value.max()) + 1 if len(value) else 1
    return np.bincount(np.unique(owner * size + value) // size, minlength=texts)


def _repeat_words(word: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words in three-word windows that their text holds twice or more."""
    if len(word) < 3:
        return np.zeros(texts, dtype=np.int64)
    size = int(word.max()) + 1
    two = np.unique(word[:-1] * size + word[1:], return_inverse=True)[1]
    three = np.unique(two[:-1] * size + word[2:], return_inverse=True)[1]
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    key = owner[whole] * (int(three.max()) + 1) + three[whole]
    where, count = np.unique(key, return_inverse=True, return_counts=True)[1:]
    start = whole[count[where] > 1]
    covered = np.zeros(len(word), dtype=bool)
    for i in range(3):
        covered[start + i] = True
    return np.bincount(owner[covered], minlength=texts)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text and the measures that rules look at."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    flat, words = common.split_words(texts)
    owner = np.repeat(np.arange(n), words)
    coded = flat.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    chars = np.asarray(pc.utf8_length(coded.dictionary), dtype=np.int64)[word]
    lettered = np.asarray(pc.match_substring_regex(coded.dictionary, r"\p{L}"))[word]

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    line_owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    full = np.asarray(pc.match_substring_regex(lines, HAS_WORD))
    line = lines.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    line_owner = line_owner[full]
    ended = np.asarray(pc.match_substring_regex(lines, r"[.!?…:;\"')\]][\x20\x09-\x0D]*$"))[full]
    n_lines = np.bincount(line_owner, minlength=n)

    def count(pattern: str) -> np.ndarray:
        return np.asarray(pc.count_substring_regex(texts, pattern), dtype=np.int64)

    letters, upper = count(r"\p{L}"), count(r"\p{Lu}")
    found = {
        "n_words": words.astype(np.int64),
        "word_chars": np.bincount(owner, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": n_lines - _distinct(line_owner, line, n),
        "n_repeat_words": _repeat_words(word, owner, n),
    }
    a_word, a_line = np.maximum(words, 1), np.maximum(n_lines, 1)
    found |= {
        "mean_word": found["word_chars"] / a_word,
        "symbols_a_word": found["n_symbols"] / a_word,
        "symbol_runs_a_word": count(SYMBOLS + "{3}") / a_word,
        "dup_line_share": found["n_dup_lines"] / a_line,
        "repeated_share": found["n_repeat_words"] / a_word,
        "letter_words": np.bincount(owner, weights=lettered, minlength=n) / a_word,
        "ended_lines": np.bincount(line_owner, weights=ended, minlength=n) / a_line,
        "distinct_share": np.where(words < 500, 1.0, _distinct(owner, word, n) / a_word),
        "upper_share": upper / np.maximum(letters, 1),
    }
    return found


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """``(text, rule)``: 1 keeps, -1 drops, 0 abstains."""
    out = []
    for name, low, high, bad_low, bad_high in RULES:
        value = found[name]
        good = (value >= low) & (value <= high)
        bad = (value < bad_low) | (value > bad_high)
        out.append(np.where(bad, -1, np.where(good, 1, 0)))
    return np.stack(out, axis=1)


def _pattern(given: np.ndarray) -> np.ndarray:
    return (given + 1) @ 3 ** np.arange(given.shape[1])


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1


def fit_votes(given: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Posterior probability that a text with each row of votes is good.

    Expectation-maximisation over the votes' tables of accuracy: how often each rule keeps,
    abstains and drops, given a good and given a bad text, and the share of good texts. It
    starts from the number of drop votes. A rule whose vote would speak for the other class
    is given the same chances in both, so that good stays what the rules call good.
    """
    cast = np.stack([given == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(3.0 * (given < 0).sum(axis=1) - 2.0))
    for _ in range(ROUNDS):
        chance = []
        for weight in (good * count, (1 - good) * count):
            seen = np.einsum("p,prv->rv", weight, cast) + SMOOTH
            chance.append(seen / seen.sum(axis=1, keepdims=True))
        told = np.log(chance[0] / chance[1])
        told[:, 0], told[:, 2] = np.minimum(told[:, 0], 0), np.maximum(told[:, 2], 0)
        prior = float(np.clip((good * count).sum() / max(count.sum(), 1), *PRIOR))
        odds = np.log(prior / (1 - prior)) + np.einsum("rv,prv->p", told, cast)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - good).max(initial=0) < CLOSE:
            return new
        good = new
    return good


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, …, n_repeat_words, votes)`` of each whole text.

    A null or empty text has no words, lines or symbols. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")]
                    + [pa.array(found[c]) for c in BASE]
                    + [pa.array(_pattern(votes(found)))],
                    ["doc_id", *BASE, "votes"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = ", ".join(f"{c} long" for c in BASE)
    return rows.mapInArrow(run, f"doc_id long, {columns}, votes long")


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, …, n_repeat_words, base_failed, quality, kept)``, a row a document.

    ``quality`` is the posterior of the document's votes; ``kept`` needs at least ``least``
    and no base failure: fewer than 50 words, or over half of them in repeated windows.
    Votes are counted by pattern, at most three to the power of the number of rules, so
    the driver fits a table of fixed size. An empty table gives no rows.
    """
    rows = materialize(measured(docs))
    counted = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    pattern = np.array([r["votes"] for r in counted], dtype=np.int64)
    quality = fit_votes(_unpack(pattern), np.array([r["n"] for r in counted], dtype=float))
    # One row a pattern that occurs: small by the number of rules, so it is sent to all tasks.
    known = common.literal_table(
        docs.sparkSession,
        [{"votes": int(p), "quality": float(q)} for p, q in zip(pattern, quality)],
        "votes long, quality double",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    found = rows.join(F.broadcast(known), "votes")
    found = found.select("doc_id", *BASE, failed.alias("base_failed"), "quality")
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
