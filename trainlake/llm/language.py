"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value, slices

ship_by_value(__name__)

UNKNOWN = "und"
FOLDS = 5
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``bits``: n-grams are hashed to 2**bits features. ``per_language``: the documents that
    are fitted to, at most, of each language; the document frequencies cover all documents."""

    bits: int = 14
    longest: int = 3
    per_language: int = 1000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01


@dataclass
class Model:
    """Languages, weights (features and a constant, by language), IDF and temperature."""

    settings: Settings
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    idf: np.ndarray | None = None
    temperature: float = 1.0


class Grams:
    """Hashed character n-grams of texts. Letters are lower-cased, every run of anything else
    is one blank."""

    TABLE = 0x3000

    def __init__(self, settings: Settings):
        self.settings = settings
        chars = [chr(c) for c in range(self.TABLE)]
        self.letter = np.array([c.isalpha() for c in chars])
        self.lower = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)

    def letters(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which code points are letters, and their lower case."""
        near = codes < self.TABLE
        small = np.where(near, codes, 0)
        is_letter, lower = self.letter[small], self.lower[small]
        if not near.all():
            far, at = np.unique(codes[~near], return_inverse=True)
            is_letter[~near] = np.array([chr(c).isalpha() for c in far.tolist()])[at]
            lower[~near] = codes[~near]
        return is_letter, lower

    def features(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bool]]:
        """For each text the buckets of all its n-grams, and whether it has a letter."""
        joined = "".join(texts.to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())]).astype(np.int64)
        is_letter, lower = self.letters(codes)
        before = np.concatenate([[False], is_letter[:-1]])
        before[ends[:-1][ends[:-1] < len(codes)]] = False
        keep = is_letter | before
        symbols = np.where(is_letter, lower, 32)[keep].astype(np.uint64)
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        has_letter = np.concatenate([[0], np.cumsum(is_letter[keep])])[ends]
        shift = np.uint64(64 - self.settings.bits)
        buckets, whole = [], np.zeros(len(symbols), np.uint64)
        for n in range(1, self.settings.longest + 1):
            whole = whole[: len(symbols) - n + 1] * np.uint64(0x110001) + symbols[n - 1 :]
            buckets.append((((whole + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            own = [grams[a : max(a, b - n)] for n, grams in enumerate(buckets)]
            yield np.concatenate(own), bool(has_letter[k + 1] > has_letter[k])


def learnable(id_: Column) -> Column:
    """Rows outside the held-out fold; rows without an id are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) != 0, F.lit(False))


def document_frequencies(docs: DataFrame, settings: Settings) -> np.ndarray:
    """In how many of the documents each feature occurs, and behind them the number of
    documents; counted over all rows, one partial count per feature and task."""
    size = 1 << settings.bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(settings), np.zeros(size + 1, np.int64)
        for part in slices(batches, "text", SLICE_BYTES):
            for buckets, has_letter in grams.features(part.column("text")):
                if has_letter:
                    seen[np.unique(buckets)] += 1
                    seen[size] += 1
        found = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["feature", "n"])

    counted = docs.select("text").mapInArrow(task, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    return out


def vector(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a text of unit length: counts by IDF, and the constant."""
    counts = np.bincount(buckets, minlength=len(idf))
    at = np.nonzero(counts)[0]
    values = counts[at] * idf[at]
    length = np.sqrt((values**2).sum())
    return np.append(at, len(idf)), np.append(values / (length or 1.0), 1.0)


def softmax(scores: np.ndarray) -> np.ndarray:
    top = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return top / top.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, proximal, with elastic-net penalties, for softmax loss."""

    def __init__(self, features: int, classes: int, settings: Settings):
        self.s = settings
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.s.l1, 0)
        return -shrunk / ((self.s.beta + np.sqrt(self.n[at])) / self.s.alpha + self.s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, to about a hundredth. The targets are
    smoothed for the size of the sample: ``n`` right answers do not prove certainty."""
    if len(labels) == 0:
        return 1.0
    n, classes = scores.shape
    sure = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(scores / t), 1e-300))
        right = p[np.arange(n), labels]
        rest = (p.sum(axis=1) - right) / max(1, classes - 1)
        return float(-(sure * right + (1 - sure) * rest).mean())

    return float(min(np.geomspace(0.02, 20, 700), key=loss))


def looked_up(by_language: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in by_language.items() for x in pair])[F.col("lang")]


def sample_bounds(ranks: DataFrame, sizes: dict[str, int], wanted: int) -> dict[str, int]:
    """For each language the greatest rank among its ``wanted`` smallest ones.

    Ranks are hashes, evenly spread over the signed 64-bit numbers, so rows beyond the share that
    holds about twice as many as wanted need not be looked at; few rows of a frequent language
    reach the task that orders them."""
    shares = {lang: min(1.0, 2 * (wanted + 50) / n) for lang, n in sizes.items()}
    cuts = {lang: min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)) for lang, share in shares.items()}
    first = Window.partitionBy("lang").orderBy("rank")
    near = ranks.filter(F.col("rank") <= looked_up(cuts)).withColumn("nth", F.row_number().over(first))
    found = near.filter(F.col("nth") <= wanted).groupBy("lang").agg(F.max("rank").alias("bound")).collect()
    return dict.fromkeys(sizes, -(1 << 63)) | {r["lang"]: r["bound"] for r in found}


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit to the learnable rows that have a language.

    IDF comes from all of them. The weights come from at most ``per_language`` rows of each
    language, those with the smallest hash of their id; they are fitted in one task of that
    bounded size, in the order of the hash. Every fifth row of the sample is left out of the
    weights and sets the temperature. Without labelled rows the model knows no language.
    """
    known = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    known = known.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("rank", F.xxhash64("doc_id"))
    sizes = known.groupBy("lang").count().collect()
    model = Model(settings, sorted(r["lang"] for r in sizes))
    if not sizes:
        return model
    bounds = sample_bounds(known.select("lang", "rank"), {r["lang"]: r["count"] for r in sizes}, settings.per_language)
    counted = document_frequencies(known, settings)
    model.idf = idf = np.log((1 + counted[-1]) / (1 + counted[:-1])) + 1
    languages = model.languages
    sample = known.filter(F.col("rank") <= looked_up(bounds))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(settings)
        for part in slices(batches, "text", SLICE_BYTES):
            rows = [vector(b, idf) if ok else (None, None) for b, ok in grams.features(part.column("text"))]
            at = pa.array([a for a, _ in rows], pa.list_(pa.int32()))
            x = pa.array([v for _, v in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("lang"), at, x], names=["rank", "lang", "features", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                at, x = (batch.column(c)[k].values.to_numpy() for c in ("features", "x"))
                rows.append((at.copy(), x.astype(np.float64), languages.index(lang)))
        learner = Ftrl(len(idf) + 1, len(languages), settings)
        for _ in range(settings.epochs):
            for k, row in enumerate(rows):
                if k % FOLDS:
                    learner.learn(*row)
        weights = learner.weights()
        aside = rows[::FOLDS]
        scores = np.array([x @ weights[at] for at, x, _ in aside])
        t = temperature(scores, np.array([label for *_, label in aside], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([t])], names=["weights", "temperature"])

    ready = sample.mapInArrow(vectors, "rank long, lang string, features array<int>, x array<float>").filter("features IS NOT NULL")
    (fitted,) = ready.repartition(1).sortWithinPartitions("rank", "lang").mapInArrow(train, "weights binary, temperature double").collect() or [None]
    if fitted is None:
        return Model(settings)
    model.weights = np.frombuffer(bytes(fitted["weights"])).reshape(-1, len(languages))
    model.temperature = fitted["temperature"]
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the predicted language of the whole text with its calibrated
    probability: from the text alone. A null text, one without a letter, and any text under a
    model without languages is ``und`` with score 0. Nothing is shuffled; an input column of
    the name of a new one is a ``ValueError``."""
    clash = {prediction, score} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    settings, languages, temp = model.settings, model.languages, model.temperature
    weights = None if model.weights is None else model.weights[:-1] * model.idf[:, None]
    constant = None if model.weights is None else model.weights[-1]
    idf = model.idf
    # By their places: Spark cannot send a column with a dot in its name to Python.
    columns = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    text = f"c{[c.lower() for c in columns].index(text_col.lower())}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(settings)
        for part in slices(batches, text, SLICE_BYTES):
            names, scores = [], []
            for buckets, has_letter in grams.features(part.column(text).fill_null("")):
                if not has_letter or weights is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                counts = np.bincount(buckets, minlength=len(idf)).astype(np.float64)
                length = np.sqrt(((counts * idf) ** 2).sum()) or 1.0
                p = softmax((counts @ weights / length + constant) / temp)
                best = int(p.argmax())
                names.append(languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, prediction, score])

    return plain.mapInArrow(task, f"{fields}, `{prediction}` string, `{score}` double")


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model fitted to the rows that
    are not held out. Null ids count as held out; repeated rows are answered each; an empty
    table gives no rows; other columns are ignored."""
    model = fit(docs, settings, id_col, text_col, lang_col)
    rows = docs.select(col(id_col).alias("doc_id"), (~learnable(col(id_col))).alias("held_out"), col(text_col).alias("text"))
    return predict(rows, model).drop("text")
