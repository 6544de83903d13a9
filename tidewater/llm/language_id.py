"""Language ID with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.words import slices

BUCKETS = 4096  # hashed byte n-grams
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams of the lower-cased text; length one."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(263) + raw[2:] + np.uint32(1 << 20)
    hashed = (np.concatenate([pairs, triples]) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(hashed, minlength=BUCKETS).astype(np.float32)
    return np.sqrt(counts / counts.sum())


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: columns split the languages, rows lie far apart."""
    length, rng = 7 + 4 * max(1, int(np.ceil(np.log2(max(2, n))))), np.random.default_rng(seed)
    best, spread = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1]), size=(n, length))
        if n > 1:
            for k in np.flatnonzero(np.abs(code.sum(axis=0)) == n):
                code[rng.integers(n), k] *= -1
        apart = min((int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)), default=length)
        if apart > spread:
            best, spread = code, apart
    return best.astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def losses(self, texts: list[str]) -> np.ndarray:
        """The weighted logistic loss of every codeword for every text."""
        margins = np.stack([features(t) for t in texts]) @ self.weights + self.bias
        agreement = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -agreement) * self.trust).sum(axis=2)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once by accelerated gradient steps."""
    n = len(x)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    look_w, look_b, rate = w, b, np.float32(4.0 / 1.25)  # rows have length one
    for k in range(steps):
        g = (-y / (1 + np.exp(np.clip(y * (x @ look_w + look_b), -30, 30)))) / n
        new_w, new_b = look_w - rate * (x.T @ g + penalty * look_w), look_b - rate * g.sum(axis=0)
        pull = np.float32(k / (k + 3))
        look_w, look_b, w, b = new_w + pull * (new_w - w), new_b + pull * (new_b - b), new_w, new_b
    return w, b


def train_language_id(rows: DataFrame, per_language: int = 600, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn one binary n-gram classifier for each bit of the languages' codewords.

    ``rows`` are labelled; those with a null language, a null text or no letter are not used, and
    rows of one language with the same text count once.  The fit takes at most ``per_language``
    texts of each language, those of least hash of the text: a bound on the training sample that
    doesn't depend on the input.  Counts of different texts tell where to cut the hashes, so no
    task gets more than a few times that number.  Tasks make the feature vectors, so the driver
    gets vectors of a fixed width, never texts.
    """
    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(23), F.col(text_col)).alias("h")
    )

    def under(bounds: list[tuple[str, int]]) -> Column:
        """Hashes up to a bound for each language."""
        found = F.lit(False)
        for lang, most in bounds:
            found = found | ((F.col("lang") == lang) & (F.col("h") <= most))
        return found

    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row for each language
    about = [(r["lang"], int(min(1.0, 3 * per_language / max(1, r["n"])) * 2**64) - 2**63 - 1) for r in sizes]
    least = Window.partitionBy("lang").orderBy("h")
    few = usable.select("lang", "h").where(under(about)).distinct().withColumn("k", F.row_number().over(least)).where(F.col("k") <= per_language)
    bounds = [(r["lang"], r["most"]) for r in few.groupBy("lang").agg(F.max("h").alias("most")).collect()]
    if not bounds:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["lang", "h", "x"])

    sample = usable.where(under(bounds)).mapInArrow(vectors, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x")).collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in sample})
    code = codewords(len(languages))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in sample]).astype(np.float32)
    y = code[[languages.index(r["lang"]) for r in sample]]
    weights, bias = _fit(x, y)
    right = ((x @ weights + bias) * y > 0).mean(axis=0)
    return LanguageModel(languages, code, weights, bias, (right / right.sum()).astype(np.float32) * len(right))


def identify_language(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.6, text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    The bits' classifiers vote; the codeword with the least weighted loss wins, of equal ones that
    of the language first by code points.  Returns the
    columns of ``docs`` and ``_lang`` (``und`` if the text is null or has no letter, or nothing
    was learned), ``_score`` (the share of the winner among the codewords, 0 to 1; 0 for
    ``und``) and ``_ambiguous`` (the score is below ``ambiguous_below``).  Repeated rows,
    extra columns and empty tables need no care.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in slices(batches):
            texts = batch.column(names.index(text_col)).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            readable = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
            for k in range(0, len(readable), 256):
                rows = readable[k : k + 256]
                losses = model.losses([texts[i] for i in rows])
                share = np.exp(losses.min(axis=1, keepdims=True) - losses)
                share /= share.sum(axis=1, keepdims=True)
                for i, best, s in zip(rows, losses.argmin(axis=1), share.max(axis=1)):
                    langs[i], scores[i] = model.languages[best], float(min(1.0, s))
            unsure = [s < ambiguous_below for s in scores]
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "_lang", "_score", "_ambiguous"])

    added = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_ambiguous", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def is_held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
