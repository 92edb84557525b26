"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions
in time linear in the features present (Rendle 2010).  Features are counted in parallel from whole texts; the model
is fitted in one task on a bounded sample of labelled rows, and travels to the scoring tasks as one small row.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import word_blocks

#: Hash buckets of words; bins of a statistic (one more for a missing value); factors of an interaction.
WORDS, BINS, FACTORS = 1 << 12, 8, 8
_SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_UPPER, _LOWER, _DIGITS = [bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58))]
STATISTICS = ("words", "word_length", "upper", "digits", "symbols", "non_ascii", "distinct_words", "line_words",
              "repeated_lines", "marked_words", "commonest_word", "sentence_ends", "stated_length")


def features(text: bytes | None, stated: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Word counts by hash bucket, scaled to length 1, and the structure statistics; ``stated`` is the length that
    the metadata give.  Words are counted block by block, so a huge text takes a small multiple of its size."""
    text = text or b""
    hashed = np.zeros(WORDS)
    codes, times, total, marked, letters = [np.empty(0, np.int64)], [np.empty(0)], 0, 0, 0
    for words in word_blocks(text.lower()):
        counts = Counter(words)
        codes.append(np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)))
        times.append(np.fromiter(counts.values(), np.float64, len(counts)))
        hashed += np.bincount(codes[-1] % WORDS, times[-1], WORDS)
        total += len(words)
        letters += sum(map(len, words))
        marked += sum(n for w, n in counts.items() if not w.strip(b".,;:!?\"'()").isalnum() and w.isascii())
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    commonest = np.bincount(place, np.concatenate(times)).max() if len(distinct) else 0
    size = max(len(text), 1)
    upper, lower, digits, symbols = [len(text) - len(text.translate(None, kind)) for kind in (_UPPER, _LOWER, _DIGITS, _SYMBOLS)]
    ascii_size = upper + lower + digits + symbols + sum(text.count(c) for c in (b" ", b"\n", b"\t", b"\r"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    hashed = np.sqrt(hashed).astype(np.float32)
    norm = float(np.sqrt((hashed * hashed).sum())) or 1.0
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    seen = max(total, 1)
    statistics = [np.log1p(total), letters / seen, upper / max(upper + lower, 1), digits / size, symbols / size,
                  1 - ascii_size / size if text else 0.0, len(distinct) / seen ** 0.8, np.log1p(total / max(len(lines), 1)),
                  1 - len(set(lines)) / max(len(lines), 1), marked / seen,
                  commonest / seen, ends / seen,
                  np.nan if stated is None or stated != stated else np.log1p(max(stated, 0.0))]
    return hashed / norm, np.array(statistics, np.float32)


@dataclass
class Model:
    """Bin edges of the statistics, and the weights."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def binned(self, statistics: np.ndarray) -> np.ndarray:
        """One 1 per statistic, in its bin."""
        out = np.zeros((len(statistics), len(STATISTICS), BINS + 1), np.float32)
        for j, edges in enumerate(self.edges):
            column = statistics[:, j]
            place = np.where(np.isnan(column), BINS, np.searchsorted(edges, column, side="right"))
            out[np.arange(len(out)), j, place] = 1
        return out.reshape(len(out), -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        crossed = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (crossed * crossed - (x * x) @ (self.factors * self.factors)).sum(1)

    def scores(self, words: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(np.hstack([words, self.binned(statistics)])).astype(np.float64)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, edges=self.edges, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        found = np.load(io.BytesIO(data))
        return cls(found["edges"], float(found["bias"]), found["weights"], found["factors"])


def fit(words: np.ndarray, statistics: np.ndarray, labels: np.ndarray, rounds: int = 12, rate: float = 0.05,
        decay: float = 1e-4, batch: int = 64, seed: int = 3) -> Model:
    """Adagrad on the logistic loss.  Without rows of both labels the model is the smoothed share of label 1."""
    size = WORDS + len(STATISTICS) * (BINS + 1)
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    inner = np.arange(1, BINS) / BINS
    edges = np.array([np.nanquantile(c, inner) if np.isfinite(c).any() else np.zeros(BINS - 1) for c in statistics.T]
                     if len(labels) else np.zeros((len(STATISTICS), BINS - 1)), np.float32)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size, np.float32),
                  np.zeros((size, FACTORS), np.float32))
    if len(np.unique(labels)) < 2:
        return model
    model.factors = rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    x = np.hstack([words, model.binned(statistics)]).astype(np.float32)
    sums = [1e-6, np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32)]
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            part = x[rows]
            error = ((1 / (1 + np.exp(-model.logits(part)))) - labels[rows]).astype(np.float32) / len(rows)
            crossed = part @ model.factors
            slopes = [float(error.sum()), part.T @ error + decay * model.weights,
                      part.T @ (error[:, None] * crossed) - ((part * part).T @ error)[:, None] * model.factors + decay * model.factors]
            sums = [s + g * g for s, g in zip(sums, slopes)]
            model.bias -= rate * slopes[0] / sums[0] ** 0.5
            model.weights = model.weights - rate * slopes[1] / np.sqrt(sums[1])
            model.factors = model.factors - rate * slopes[2] / np.sqrt(sums[2])
    return model


def remainder(ident: Column, folds: int = 5) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; null for a null identifier."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
          label_col: str = "quality", sample: int = 6000) -> Model:
    """The model of up to ``sample`` labelled documents outside fold 0, drawn by a hash of the identifier.

    An identifier with several labels counts as 1 if their mean is at least a half; null labels and identifiers
    don't count.  Documents that share a labelled identifier all count.
    """
    chosen = materialise(
        labels.where((remainder(F.col(id_col)) != 0) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample), "quality-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("binary").alias("text"),
                       _length(docs, length_col).alias("stated"))
    known = rows.join(F.broadcast(chosen), F.col("id") == F.col("_id")).drop("_id")  # at most ``sample`` rows of two numbers

    def count(batches):
        for part in batches:
            found = [features(t, s) for t, s in zip(part["text"], part["stated"])]
            yield pd.DataFrame({"id": part["id"], "tie": part["tie"], "label": part["_label"],
                                "words": [w.astype(np.float16).tobytes() for w, _ in found],
                                "statistics": [s.tobytes() for _, s in found]})

    counted = materialise(known.mapInPandas(count, "id long, tie long, label int, words binary, statistics binary"),
                          "quality-features")

    def learn(batches):
        part = pd.concat([pd.DataFrame({"words": [], "statistics": [], "label": []}), *batches])
        words = np.array([np.frombuffer(w, np.float16) for w in part["words"]], np.float32).reshape(-1, WORDS)
        statistics = np.array([np.frombuffer(s, np.float32) for s in part["statistics"]], np.float32).reshape(-1, len(STATISTICS))
        yield pd.DataFrame({"model": [fit(words, statistics, part["label"].to_numpy(np.float32)).to_bytes()]})

    # Documents can share an identifier, so the rows are bounded once more.
    bounded = counted.orderBy(F.md5(F.col("id").cast("string")), "id", "tie").limit(sample).coalesce(1)
    return Model.from_bytes(bytes(bounded.mapInPandas(learn, "model binary").first()["model"]))


def _length(docs: DataFrame, length_col: str) -> Column:
    return F.col(length_col).cast("double") if length_col in docs.columns else F.lit(None).cast("double")


def score(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars") -> Column:
    """The score of each row of ``docs``, 0 to 1, higher when label 1 is likelier; a null text counts as empty."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series, stated: pd.Series) -> pd.Series:
        out = []
        for first in range(0, len(texts), 256):
            found = [features(t, s) for t, s in zip(texts[first:first + 256], stated[first:first + 256])]
            out.append(model.scores(np.array([w for w, _ in found]), np.array([s for _, s in found])))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return scores(F.col(text_col).cast("binary"), _length(docs, length_col))
