"""Language identification with string kernels: presence of character n-grams, Nyström landmarks, and ridge
regression of one language against the rest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fleetlens.llm import common as c

BITS = 18
ORDERS = (1, 2, 3)
#: Labelled rows of a language that a model is fitted on, and landmarks of a language.
SAMPLE_ROWS, LANDMARKS, RIDGE = 600, 50, 1e-3
#: Parts of a language in which rows are ranked before they are ranked in all of it.
SAMPLE_PARTS = 64
UNKNOWN = "und"
_FEATURES = pa.schema([("lang", pa.string()), ("features", pa.binary())])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case (a blank if it is no letter or mark), and whether it is a letter."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.full(0x110000, 32, np.uint32)
    at = np.flatnonzero(letter)
    lower[at] = [ord(s) if len(s := chr(i).lower()) == 1 else i for i in at.tolist()]
    return lower, letter


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct hashed n-grams of each whole text, and whether it has a letter."""
    data, offsets = c.buffers(texts)
    lower, letter = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = heads[offsets].tolist()
    is_letter = np.concatenate(([0], np.cumsum(letter[points])))[bounds]
    s = lower[points].astype(c.U)
    grams, h = [], np.zeros(len(s), c.U)
    for k in range(max(ORDERS)):
        h = h[: max(len(s) - k, 0)] * c.BASE + s[k:]
        if k + 1 in ORDERS:
            grams.append((c.mix(h + c.U(k << 56)) >> c.U(64 - BITS)).astype(np.int32))
    seen = np.zeros(1 << BITS, bool)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        mine = [g[a : max(b - k + 1, a)] for k, g in zip(ORDERS, grams)]
        for g in mine:
            seen[g] = True
        found = np.flatnonzero(seen).astype(np.int32)
        seen[found] = False
        out.append(found)
    return out, np.diff(is_letter) > 0


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.steps(batches):
        found, letters = features(batch.column("text"))
        rows = [(lang, f.tobytes()) for lang, f, ok in zip(batch.column("lang").to_pylist(), found, letters) if ok]
        if rows:
            yield c.rows(_FEATURES, *zip(*rows))


def learned_rows(docs: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text) of at most `sample_rows` different rows of each language, those with the least digests of id and text.

    Rows that agree in both count once; rows that only share an id, or have none, are rows of their own."""
    text, held = F.col("text").cast("string"), may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()
    digest = F.md5(F.concat(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    rows = docs.where(held).select(F.col("lang").cast("string").alias("lang"), text.alias("text"), digest.alias("digest"))
    # Ranks within parts of a language first, so that no task sees more than the first rows of each part.
    place = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy("digest"))
    part = rows.select("lang", "digest").withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(SAMPLE_PARTS)))
    first = part.groupBy("lang", "part", "digest").agg(F.lit(1).alias("one")).withColumn("place", place("lang", "part")).where(F.col("place") <= sample_rows)
    least = first.withColumn("place", place("lang")).where(F.col("place") <= sample_rows)
    limits = {r.lang: r.most for r in least.groupBy("lang").agg(F.max("digest").alias("most")).collect()}  # one row per language
    if not limits:
        return rows.select("lang", "text").limit(0)
    most = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    return rows.where(F.col("digest") <= F.element_at(most, F.col("lang"))).dropDuplicates(["lang", "digest"]).select("lang", "text")


class Model:
    """Weights of each hashed n-gram for each language.

    The kernel of two texts is the number of n-grams in both over the root of the product of their numbers. Rows
    are mapped to kernels with the landmarks, whitened, and regressed; as the kernel is a product of presences,
    landmarks, whitening and regression multiply out to one matrix, and a batch is scored by one product."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    @classmethod
    def fit(cls, langs: list[str], rows: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        names = sorted(set(langs))
        y = np.array([names.index(x) for x in langs])
        chosen = np.sort(np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))]))
        vocabulary = np.unique(np.concatenate([rows[i] for i in chosen]))
        basis = np.zeros((len(chosen), len(vocabulary)), np.float32)
        for k, i in enumerate(chosen):
            basis[k, np.searchsorted(vocabulary, rows[i])] = 1 / np.sqrt(max(len(rows[i]), 1))
        dense = np.zeros((1 << BITS,), np.int64) - 1
        dense[vocabulary] = np.arange(len(vocabulary))
        columns = np.ascontiguousarray(basis.T)
        kernel = np.zeros((len(rows), len(chosen)))
        for i, r in enumerate(rows):
            at = dense[r]
            kernel[i] = columns[at[at >= 0]].sum(0) / np.sqrt(max(len(r), 1))
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-8 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = np.hstack((kernel @ whiten, np.ones((len(rows), 1))))
        goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
        counts = np.bincount(y, minlength=len(names))
        weight = (len(y) / (len(names) * counts))[y][:, None]
        gram = phi.T @ (phi * weight) + ridge * len(rows) * np.diag([1.0] * (phi.shape[1] - 1) + [0.0])
        beta = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), phi.T @ (goal * weight))
        weights = np.zeros(((1 << BITS) + 1, len(names)))
        weights[vocabulary] = basis.T @ (whiten @ beta[:-1])
        weights[-1] = beta[-1]
        return cls(names, weights)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Regression values of each row for each language."""
        out = np.tile(self.weights[-1], (len(rows), 1))
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            sizes = np.array([len(rows[i]) for i in full])
            terms = self.weights[np.concatenate([rows[i] for i in full])]
            sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
            out[full] += sums / np.sqrt(sizes)[:, None]
        return out


def fit(docs: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model of the labelled rows that `may_learn` admits; None if there are none with a letter.

    The sample is bounded by `sample_rows` a language, whatever the doc_ids: null or repeated ones are told apart by their
    text. Only hashed n-grams, at most 2 ** BITS of a row, reach the driver."""
    c.bounded_batches(docs.sparkSession)
    found = learned_rows(docs, may_learn, sample_rows).mapInArrow(_extract, "lang string, features binary").collect()
    rows = sorted((r.lang, bytes(r.features)) for r in found)
    if not rows:
        return None
    order = np.random.default_rng(0).permutation(len(rows))
    rows = [rows[i] for i in order]
    return Model.fit([r[0] for r in rows], [np.frombuffer(r[1], np.int32) for r in rows], landmarks)


def predict_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows with all their columns, and lang_pred and score (0 to 1), which replace columns so named.

    `und` with score 0 for a null text or one without a letter, and for all without a model. Nothing but the
    text, as a whole, is used."""
    c.bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).fill_null("")
            for at, found, letters in _found(texts):
                if model is None:
                    letters[:] = False
                    labels, scores = [UNKNOWN] * len(found), np.zeros(len(found))
                else:
                    values = model.score(found)
                    labels = [model.langs[k] if ok else UNKNOWN for k, ok in zip(values.argmax(1), letters)]
                    scores = np.where(letters, np.clip((values.max(1) + 1) / 2, 0, 1), 0.0)
                rows = batch.slice(at, len(found))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def _found(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, features, letters) of steps of a column."""
    at = 0
    for part in c.steps([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        yield (at, *features(part.column("text")))
        at += part.num_rows


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document, see `predict_rows`. Other columns are ignored."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return predict_rows(texts, model).select("doc_id", "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
