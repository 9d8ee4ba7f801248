"""Language identification by nearest centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.llm import common
from kinsheet.session import materialize

#: Hashed n-gram dimensions, and the n-gram lengths that share them.
DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
CENTROIDS = 4
#: Labelled rows a language that centroids are fitted on; document frequencies use all rows.
FIT_ROWS = 1000
#: Rows of the sample that are sent to all tasks; a larger one is joined by a shuffle.
SENT_ROWS = 1 << 20
UNKNOWN = "und"
#: A text is rejected below this share of the similarity that the farthest hundredth of the
#: fitted texts of its length class still has.
REJECT_SHARE = 0.5
#: Texts whose vectors are held at once.
BLOCK_TEXTS = 512
#: Length classes: powers of two of the number of letters. One with fewer fitted texts than
#: this says too little about how far a good text may be: cut longer texts are added, and what
#: is still thin takes the floor of the next shorter class.
CLASSES = 32
CLASS_TEXTS = 64
#: Fitted texts a language that are also cut to every shorter length class.
CUT_TEXTS = 96

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
        _letters = np.fromiter((k == "L" for k in kinds), bool, 0x110000)
    return _letters


def _letter_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with 0 for each run of others, the text of each, letter counts."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    n = np.asarray(pc.utf8_length(lowered), dtype=np.int64)
    data = "".join(lowered.to_pylist()).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, dtype=np.uint32)
    owner = np.repeat(np.arange(len(n)), n)
    letter = _is_letter()[codes]
    letters = np.bincount(owner[letter], minlength=len(n))
    codes = np.where(letter, codes, 0)
    new_text = np.ones(len(codes), dtype=bool)
    new_text[1:] = owner[1:] != owner[:-1]
    stays = letter.copy()
    stays[1:] |= letter[:-1] & ~new_text[1:]
    return codes[stays], owner[stays], letters


def _counts(codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """``(text, dimension)`` counts of the hashed n-grams that hold a letter."""
    slot = np.zeros(texts * DIMENSIONS, dtype=np.int64)
    base = owner * DIMENSIONS
    hashed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        if n not in GRAMS:
            continue
        whole = owner[:m] == owner[n - 1 :]
        if n == 1:
            whole &= codes > 0
        key = base[:m] + (hashed >> np.uint64(64 - 12)).astype(np.int64)
        slot += np.bincount(key[whole], minlength=len(slot))
    return slot.reshape(texts, DIMENSIONS)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(start, stop, counts, letters)`` over blocks of texts."""
    for start in range(0, len(texts), BLOCK_TEXTS):
        part = texts[start : start + BLOCK_TEXTS]
        codes, owner, letters = _letter_codes(part)
        yield start, start + len(part), _counts(codes, owner, len(part)), letters


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a text without n-grams is a zero vector."""
    vectors = np.log1p(counts, dtype=np.float32) * idf.astype(np.float32)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(letters, 1)).astype(int))


@dataclass
class Model:
    """Centroids of each language, document frequencies and the similarity floors.

    ``floor`` has a row a centroid, that of its language, and a column a length class.
    """

    idf: np.ndarray
    languages: list[str] = field(default_factory=list)
    centroids: np.ndarray | None = None
    floor: np.ndarray | None = None


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _text_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                for _, _, counts, _ in _blocks(part.column("text")):
                    found[:-1] += (counts > 0).sum(axis=0)
                    texts += len(counts)
        found[-1] = texts
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMENSIONS + 1)), pa.array(found)], ["dim", "n"]
        )

    rows = labelled.select("text").mapInArrow(common.lean(run), "dim long, n long")
    total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for dim, n in rows.groupBy("dim").agg(F.sum("n")).collect():
        total[dim] = n
    return total[:-1], int(total[-1])


def _cut_vectors(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length class, texts, vectors)`` of all longer texts, cut to the fewest letters of it."""
    codes, owner, letters = _letter_codes(texts)
    kind = _length_class(letters)
    seen = np.cumsum(codes > 0)
    # Letters of a text up to each place: those before the text are taken off.
    seen -= (np.cumsum(letters) - letters)[owner]
    for c in range(int(kind.max()) if len(kind) else 0):
        longer = np.flatnonzero(kind > c)
        number = np.cumsum(kind > c) - 1
        keep = (kind > c)[owner] & (seen <= 1 << c)
        yield c, longer, _weighted(_counts(codes[keep], number[owner[keep]], len(longer)), idf)


def _vectors(labelled: DataFrame, idf: np.ndarray) -> DataFrame:
    """Vectors of the fitted texts, ``cut`` -1, and of the first of them cut to each class."""
    names = ["lang", "place", "cut", "letters", "vector"]

    def rows(part: pa.RecordBatch, cut: int, letters: np.ndarray, vectors: np.ndarray):
        return pa.RecordBatch.from_arrays(
            [
                part.column("lang"),
                part.column("place"),
                pa.array(np.full(len(letters), cut, dtype=np.int32)),
                pa.array(letters),
                pa.array([v.tobytes() for v in vectors], pa.binary()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                for start, stop, counts, letters in _blocks(part.column("text")):
                    yield rows(part.slice(start, stop - start), -1, letters, _weighted(counts, idf))
                first = part.filter(pc.less_equal(part.column("nth"), CUT_TEXTS))
                for start in range(0, first.num_rows, BLOCK_TEXTS):
                    block = first.slice(start, BLOCK_TEXTS)
                    for c, at, vectors in _cut_vectors(block.column("text"), idf):
                        cut = block.take(pa.array(at))
                        yield rows(cut, c, np.full(len(at), 1 << c, dtype=np.int64), vectors)

    return labelled.select("lang", "place", "nth", "text").mapInArrow(
        common.lean(run), "lang string, place long, cut int, letters long, vector binary"
    )


def _quantiles(whole: list[np.ndarray], cut: list[np.ndarray], least: int) -> np.ndarray:
    """Similarity that all but a hundredth of each length class reach; thin ones as the shorter.

    Classes with ``least`` texts speak for themselves, others together with longer texts cut to
    their length. NaN up to the first class that has enough.
    """
    found = np.full(len(whole), np.nan)
    for c, (own, shorter) in enumerate(zip(whole, cut)):
        have = own if len(own) >= least else np.concatenate([own, shorter])
        if len(have) >= least:
            found[c] = np.quantile(have, 0.01)
        elif c:
            found[c] = found[c - 1]
    return found


def _floors(rows: list) -> np.ndarray:
    """Floors by centroid and class. A language with few texts, whose centroids lie close to
    them, has no higher floor than the lowest of the languages with enough."""
    full, thin = (np.array([r[k] for r in rows], dtype=float) for k in ("floor", "thin"))
    others = np.where(np.isnan(full), np.inf, full).min(axis=0)
    return REJECT_SHARE * np.where(np.isnan(full), np.minimum(thin, others), full)


def _cluster(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from far-apart seeds; rows come in a fixed order, so reruns agree."""
    seeds = [vectors.mean(axis=0)]
    while len(seeds) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.stack(seeds).T, axis=1)
        seeds.append(vectors[int(np.argmin(nearest))])
    centres = np.stack(seeds)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        moved = np.stack(
            [vectors[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
        )
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centres, atol=1e-5):
            break
        centres = moved
    return centres


def fit(
    docs: DataFrame,
    centroids: int = CENTROIDS,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
) -> Model:
    """Learn from text and lang of the rows that are not held out and have both.

    Document frequencies are counted over all of them. Centroids and floors are fitted on
    ``fit_rows`` rows a language, the ones with the smallest id hashes; one task holds one
    language's.
    """
    doc_id = F.col(id_col)
    usable = ~held_out(doc_id) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    labelled = docs.where(usable & doc_id.isNotNull()).select(
        doc_id.cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    frequency, texts = _text_frequencies(labelled)
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    model = Model(idf)
    place = F.xxhash64("doc_id")
    ranked = labelled.select("doc_id", "lang", place.alias("place")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    )
    # Up to 1000 rows a language are cut to the smallest inside each task, before the shuffle.
    chosen = ranked.where(F.col("nth") <= fit_rows).groupBy("doc_id", "lang", "place")
    chosen = materialize(chosen.agg(F.min("nth").alias("nth")))
    if chosen.count() <= SENT_ROWS:
        chosen = F.broadcast(chosen)
    sample = _vectors(labelled.join(chosen, ["doc_id", "lang"]), idf)
    classes = CLASSES

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        whole = group[group["cut"] < 0].sort_values(["place", "vector"]).head(fit_rows)
        vectors = np.stack([np.frombuffer(v, dtype=np.float32) for v in whole["vector"]])
        letters = whole["letters"].to_numpy()
        full = letters > 0
        if not full.any():
            return pd.DataFrame({"lang": [], "centre": [], "floor": [], "thin": []})
        vectors, letters = vectors[full], letters[full]
        found = _cluster(vectors, centroids)

        def by_class(vectors: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
            nearest = np.max(vectors @ found.T, axis=1)
            return [nearest[kind == c] for c in range(classes)]

        own = by_class(vectors, _length_class(letters))
        short = group[group["cut"] >= 0]
        joined = np.frombuffer(b"".join(short["vector"]), dtype=np.float32)
        cut = by_class(joined.reshape(-1, DIMENSIONS), short["cut"].to_numpy())
        floor, thin = (_quantiles(own, cut, n).tolist() for n in (CLASS_TEXTS, 1))
        return pd.DataFrame(
            {
                "lang": [group["lang"].iloc[0]] * len(found),
                "centre": [c.astype(np.float32).tobytes() for c in found],
                "floor": [floor] * len(found),
                "thin": [thin] * len(found),
            }
        )

    rows = sample.groupBy("lang").applyInPandas(
        centres, "lang string, centre binary, floor array<double>, thin array<double>"
    )
    listed = sorted(rows.collect(), key=lambda r: (r["lang"], r["centre"]))
    if listed:
        model.languages = [r["lang"] for r in listed]
        model.centroids = np.stack([np.frombuffer(r["centre"], dtype=np.float32) for r in listed])
        model.floor = _floors(listed)
    return model


def _decide(model: Model, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    names: list[str] = []
    scores, rejected = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for start, stop, counts, letters in _blocks(texts):
        if model.centroids is None:
            names += [UNKNOWN] * (stop - start)
            continue
        near = _weighted(counts, model.idf) @ model.centroids.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
        known = letters > 0
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        scores[start:stop] = np.where(known, score, 0)
        rejected[start:stop] = ~known | (score < model.floor[best, _length_class(letters)])
    return names, scores, rejected


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``, one row a document.

    The language is that of the nearest centroid by cosine, the score that cosine. A null
    text or one without a letter is ``und`` with score 0 and rejected; so is every text if
    nothing was learned. Other texts are rejected when they are far from every centroid for
    their length, and still name the nearest. Only id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                names, scores, rejected = _decide(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(names, pa.string()),
                        pa.array(scores),
                        pa.array(rejected),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    columns = "doc_id long, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(common.lean(run), columns)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, as they are, whose text the model does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                _, _, rejected = _decide(model, part.column("text"))
                yield part.select(["row"]).filter(pa.array(~rejected))

    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    return packed.mapInArrow(common.lean(run), packed.select("row").schema).select("row.*")
