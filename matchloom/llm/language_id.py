"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
three-letter gram binds the vectors of its letters, permuted by their place
(rotated by two, one and no places, then multiplied); a text bundles (adds) the
vectors of all its grams.  A language's prototype bundles those of its training
texts.  A text goes to the language whose prototype has the largest cosine.

Letters are lower-cased; runs of anything else are one gap, which counts as a
letter at the start and end of a word.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is any text if nothing was learned; equal cosines go to the first language in
alphabetical order; rows without a doc_id are left out; rows that repeat a
doc_id each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, fresh_worker, slices

UNDETERMINED = "und"
DIMENSIONS = 1024
#: Vectors of so many grams exist at once; longer texts are taken in parts of about so many characters.
AT_ONCE, PART = 4096, 1 << 20
#: A text of at least so many grams has no learned language if its best cosine could be chance:
#: cosines with an unrelated prototype have a standard deviation of one over the root of the dimensions.
ENOUGH, DEVIATIONS = 50, 3.0

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        flags = np.zeros(0x110000, bool)
        flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _LETTER.append(flags)
    return _LETTER[0]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """One row of +1 and -1 per code point, the same everywhere."""
    word = np.arange(dimensions // 64, dtype=np.uint64)
    x = (points.astype(np.uint64)[:, None] << np.uint64(20)) + word + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(shift))
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


class Grams:
    """Gram counts of a group of texts: ``counts`` has a row per text, ``alphabet`` and ``codes`` name the columns."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts).lower()
        if joined.count("\0") != len(texts) - 1:  # a text holds the separator
            joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
        points = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.where(_is_letter()[points], points, 0)
        owner = np.cumsum(points == 0) - 1
        owner[-1] = len(texts) - 1
        keep = letters > 0
        keep[1:] |= (letters[1:] == 0) & (letters[:-1] > 0) & (points[1:] > 0)
        keep |= points == 0
        letters, owner = letters[keep], owner[keep]
        # One gap between words, and one at each end of a text.
        repeated = np.concatenate(([False], (letters[1:] == 0) & (letters[:-1] == 0)))
        letters, owner = letters[~repeated], owner[~repeated]
        self.alphabet, symbol = np.unique(letters, return_inverse=True)
        n = len(self.alphabet)
        a, b, c = symbol[:-2].astype(np.int64), symbol[1:-1], symbol[2:]
        real = letters[1:-1] > 0
        code = ((a * n + b) * n + c)[real]
        self.codes, gram = np.unique(code, return_inverse=True)
        self.n_texts = len(texts)
        self.flat = owner[1:-1][real] * len(self.codes) + gram

    def counts(self) -> np.ndarray:
        return np.bincount(self.flat, minlength=self.n_texts * len(self.codes)).reshape(self.n_texts, -1).astype(np.float32)

    def letters(self) -> np.ndarray:
        """Code points of each gram, three columns."""
        n = len(self.alphabet)
        return self.alphabet[np.stack((self.codes // (n * n), self.codes // n % n, self.codes % n), axis=1)]

    def bundles(self, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
        """A row per text: the sum of its grams' vectors, and its number of grams."""
        counts, letters = self.counts(), self.letters()
        out = np.zeros((self.n_texts, dimensions))
        for at in range(0, len(self.codes), AT_ONCE):
            out += counts[:, at : at + AT_ONCE] @ gram_vectors(letters[at : at + AT_ONCE], dimensions)
        return out, counts.sum(axis=1, dtype=np.float64)


def gram_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    alphabet, place = np.unique(letters, return_inverse=True)
    place = place.reshape(letters.shape)
    own = _letter_vectors(alphabet, dimensions)
    return (np.roll(own, 2, axis=1)[place[:, 0]] * np.roll(own, 1, axis=1)[place[:, 1]] * own[place[:, 2]]).astype(np.float32)


def _parts(text: str):
    """A text in parts; cut after something that is no letter, where there is, which no gram goes across."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def bundles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``Grams.bundles``, for texts of any length."""
    if max(map(len, texts)) <= PART:
        return Grams(texts).bundles(dimensions)
    each = [[sum(x) for x in zip(*(Grams([part]).bundles(dimensions) for part in _parts(text)))] for text in texts]
    return np.concatenate([v for v, _ in each]), np.concatenate([n for _, n in each])


def _groups(rows: dict[str, list], most: int = 1 << 17):
    """Texts in groups of bounded size; a longer text is alone."""
    group, held = [], 0
    for i, text in enumerate(rows["text"]):
        group.append(i)
        held += len(text)
        if held >= most or len(group) >= 64:
            yield group
            group, held = [], 0
    if group:
        yield group


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One unit vector per language from ``text, lang``; a row per language and dimension is all that the driver sees."""

    def bundle(batches):
        fresh_worker()
        sums: dict[str, np.ndarray] = {}
        for rows in slices(batches, 512):
            for group in _groups(rows):
                vectors, _ = bundles([rows["text"][i] for i in group], dimensions)
                langs = np.array([rows["lang"][i] for i in group], object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        out = pa.array([np.asarray(v, np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), out], names=["lang", "v"])

    own = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = own.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for row in sums.collect():
        out.setdefault(row["lang"], np.zeros(dimensions))[row["i"]] = row["x"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if np.linalg.norm(v) > 0}


_PREDICTED = pa.schema([("k_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict_texts(texts: list[str], names: list[str], matrix: np.ndarray, dimensions: int) -> list[tuple[str, float, int]]:
    """Language, cosine (0 if negative) and number of grams of each text of a group."""
    vectors, grams = bundles(texts, dimensions)
    norms = np.linalg.norm(vectors, axis=1)
    if not names:
        return [(UNDETERMINED, 0.0, int(n)) for n in grams]
    cosines = vectors @ matrix.T / np.maximum(norms, 1e-300)[:, None]
    best = cosines.argmax(axis=1)
    return [(names[b], float(min(1.0, max(0.0, cosines[i, b]))), int(grams[i])) if norms[i] > 0 else (UNDETERMINED, 0.0, int(grams[i])) for i, b in enumerate(best)]


def predictor(learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
    """A function of texts to (language, cosine, number of grams) of each."""
    names = list(learned)
    matrix = np.array([learned[x] for x in names], np.float64).reshape(len(names), dimensions)

    def predict(texts: list[str | None]) -> list[tuple[str, float, int]]:
        rows = {"text": [t or "" for t in texts]}
        out: list[tuple[str, float, int]] = []
        for group in _groups(rows):
            out += predict_texts([rows["text"][i] for i in group], names, matrix, dimensions)
        return out

    return predict


def identify(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, lang_pred, score`` of all documents."""
    predict = predictor(learned, dimensions)

    def run(batches):
        fresh_worker()
        out = Rows(_PREDICTED)
        for rows in slices(batches, 512):
            for doc, (lang, score, _) in zip(rows["k_id"], predict(rows["text"])):
                if out.add(doc, lang, score):
                    yield out.batch()
        yield out.batch()

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("k_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "k_id long, lang_pred string, score double").withColumnRenamed("k_id", "doc_id")


def held_out(doc_id) -> F.Column:
    """Documents that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from the documents (``doc_id, text, lang``) that aren't held out."""
    return prototypes(docs.where("doc_id is not null").where(~held_out("doc_id")), dimensions)


def keep_known(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS, enough: int = ENOUGH, deviations: float = DEVIATIONS) -> DataFrame:
    """The documents with a learned language; columns stay.

    A text without a letter goes, and one of ``enough`` grams or more whose best
    cosine isn't ``deviations`` standard deviations of chance.  Shorter texts
    say too little to be rejected.  If nothing was learned, all go.
    """
    predict = predictor(learned, dimensions)
    at = docs.columns.index("text")
    least = deviations / dimensions**0.5

    def run(batches):
        fresh_worker()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = predict(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and (n < enough or score >= least) for lang, score, n in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
