"""Operator 4: language identification with a byte convolutional network.

Network: bytes in fixed windows, filters of widths 2, 3 and 4 over learned byte embeddings, ReLU,
max pooling over the window and a softmax. Embedding and filters are folded into one table per
filter position (byte -> filter outputs), so a filter is a sum of table rows. Trained with Adam in
numpy on windows of a bounded sample: ``ROWS_PER_LANGUAGE`` rows of each language, lowest hash
first, and ``WINDOWS_PER_ROW`` windows at hashed places of each.

Prediction: every text is cut into consecutive windows that cover all of it; a document's
probabilities are the length-weighted means of its windows' softmax outputs. Pairs of neighbouring
bytes index precomputed tables, so a byte costs two look-ups for all filters.

Defined cases: null text or text without a letter is ``und`` with score 0; without any labelled
row everything is ``und``; a null id counts as the empty text in the held-out rule; repeated
rows are predicted alike; other columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanweave.llm.common import fresh, id_crc, slices, text_bytes

WINDOW = 256
FILTERS = 8
WIDTHS = (2, 3, 4)
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_ROW = 3
SALTS = 8
EPOCHS = 12
UNKNOWN = "und"


def training_windows(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, window text) of the bounded sample."""
    from pyspark.sql import Window
    rank = F.xxhash64(F.col(id_col), F.length(text_col))
    keys = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), rank.alias("rank"),
        *[F.substring(text_col, (F.pmod(F.hash(rank, F.lit(k)), F.greatest(F.length(text_col) - WINDOW // 2, F.lit(1)))
                                 + 1).cast("int"), F.lit(WINDOW)).alias(f"w{k}") for k in range(WINDOWS_PER_ROW)])
    rows = keys
    for part in (["lang", F.pmod("rank", F.lit(SALTS))], ["lang"]):   # a hot language meets in one task cut down only
        order = Window.partitionBy(*part).orderBy("rank", "w0")
        rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ROWS_PER_LANGUAGE)
    return sorted((r["lang"], r[f"w{k}"]) for r in rows.collect() for k in range(WINDOWS_PER_ROW))


class ByteConv:
    """Filters as tables: ``tables[w][k][byte]`` is what byte k of a width-w filter adds."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray):
        """Max-pooled activations of equally long windows, and where each maximum stands."""
        best, place = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias):
            n = x.shape[1] - w + 1
            act = sum(table[k][x[:, k:k + n]] for k in range(w)) + bias
            at = act.argmax(axis=1)
            best.append(np.maximum(np.take_along_axis(act, at[:, None, :], 1)[:, 0], 0))
            place.append(at)
        return np.concatenate(best, axis=1), place

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01):
        rng = np.random.default_rng(5)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo:lo + batch]
                grads = self._gradients(x[rows], y[rows])
                step += 1
                for p, g, m, v in zip(self.parameters(), grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, x, y):
        pooled, place = self.pooled(x)
        delta = softmax(pooled @ self.out + self.out_bias)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        back = (delta @ self.out.T) * (pooled > 0)
        tables, bias = [], []
        for j, (w, at) in enumerate(zip(WIDTHS, place)):
            part = back[:, j * FILTERS:(j + 1) * FILTERS]
            grad = np.zeros_like(self.tables[j])
            lanes = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(w):
                np.add.at(grad[k], (x[np.arange(len(x))[:, None], at + k], lanes), part)
            tables.append(grad)
            bias.append(part.sum(axis=0))
        return [*tables, *bias, pooled.T @ delta, delta.sum(axis=0)]

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the byte pair at t and the pair at t+2 add: (65536, all filters) and (65536, widths 3, 4)."""
        two, three, four = (t.astype(np.float32) for t in self.tables)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        here = np.concatenate([pair(two[0], two[1]) + self.bias[0], pair(three[0], three[1]) + self.bias[1],
                               pair(four[0], four[1]) + self.bias[2]], axis=1)
        zero = np.zeros_like(three[2])
        later = np.concatenate([pair(three[2], zero), pair(four[2], four[3])], axis=1)
        return here, later


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """The text's first WINDOW bytes, padded with spaces."""
    raw = text.encode()[:WINDOW]
    return np.frombuffer(raw + b" " * (WINDOW - len(raw)), np.uint8)


def train(rows: list) -> ByteConv | None:
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    model = ByteConv(languages)
    number = {lang: k for k, lang in enumerate(languages)}
    model.fit(np.stack([windows_of(text) for _, text in rows]), np.array([number[lang] for lang, _ in rows]))
    return model


BYTES_AT_ONCE = 1 << 16


def document_probabilities(model: ByteConv, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean window probabilities of each row (rows without bytes: zeros)."""
    here, later = tables
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(sizes)), count)
    start = offsets[:-1][row] + (np.arange(first[-1]) - first[row]) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    pooled = np.empty((len(row), here.shape[1]), np.float32)
    padded = np.concatenate([data, np.full(WINDOW + 4, 32, np.uint8)])
    place = np.arange(WINDOW)
    step = max(1, BYTES_AT_ONCE // WINDOW)
    for lo in range(0, len(row), step):
        s, n = start[lo:lo + step], length[lo:lo + step]
        x = padded[s[:, None] + place]
        x[place[None, :] >= n[:, None]] = 32
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        act = here[pair[:, :-2]]
        act[:, :, FILTERS:] += later[pair[:, 2:]]
        pooled[lo:lo + step] = act.max(axis=1)
    prob = softmax(np.maximum(pooled, 0) @ model.out + model.out_bias).astype(np.float64)
    out = np.zeros((len(sizes), len(model.languages)))
    np.add.at(out, row, prob * length[:, None])
    return out / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; every column is carried along."""
    model = train(training_windows(docs, may_learn, id_col, text_col, lang_col))
    tables = model.pair_tables() if model else None

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        batch = pa.record_batch([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], names=["t"])
        for part in slices([batch]):
            if model is None:
                langs, scores = langs + [UNKNOWN] * part.num_rows, scores + [0.0] * part.num_rows
                continue
            prob = document_probabilities(model, tables, *text_bytes(part.column(0)))
            langs += [model.languages[k] for k in prob.argmax(axis=1)]
            scores += prob.max(axis=1).tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang", "score"])

    got = fresh(docs, "_lang")
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (docs.withColumn(got, F.when(letters, predict(F.col(text_col))))
                .withColumn(lang_out, F.coalesce(F.col(f"{got}.lang"), F.lit(UNKNOWN)))
                .withColumn(score_out, F.least(F.coalesce(F.col(f"{got}.score"), F.lit(0.0)), F.lit(1.0)))
                .drop(got))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_crc("doc_id") % 3 == 1
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
