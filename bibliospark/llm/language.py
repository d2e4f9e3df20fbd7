"""Language ID by a byte convolutional network.

Filters of several widths over bytes, a maximum over the window, and a softmax layer. As the input of a filter is
one of 256 bytes, a filter is a table of a value a byte for each of its places, and its output the sum of the looked-up
values. It is trained in numpy with Adam on windows of a bounded sample of labelled documents (``per_language``
documents a language at most, ``windows`` windows each), and applied to all windows of fixed length of a whole text;
a document's score is the mean of its windows' log probabilities.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything where there is
nothing to learn from; short texts are padded with zero bytes; ties go to the first language in order of name;
repeated rows get the same prediction; very long texts are applied in batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, fresh, give_back, small_batches

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 24, 256


class ByteConvNet:
    """``tables``: by width, float32 of (place, byte, filter)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.pairs: list[list[np.ndarray]] | None = None

    def freeze(self) -> None:
        """Tables of two places at once: half as many look-ups when applied."""
        self.pairs = [[(t[i][:, None] + t[i + 1][None]).reshape(65536, FILTERS) for i in range(0, len(t) - 1, 2)] for t in self.tables]

    def features(self, windows: np.ndarray, places: bool = False):
        """(n, filters) maxima over each window, and where they were."""
        found, at = [], []
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:] if self.pairs else None
        for k, (table, bias) in enumerate(zip(self.tables, self.bias)):
            width, count = len(table), windows.shape[1] - len(table) + 1
            if self.pairs:
                z = self.pairs[k][0][pair[:, :count]]
                for i in range(2, width - 1, 2):
                    z += self.pairs[k][i // 2][pair[:, i : i + count]]
                if width % 2:
                    z += table[width - 1][windows[:, width - 1 : width - 1 + count]]
            else:
                z = sum(table[i][windows[:, i : i + count]] for i in range(width))
            found.append(z.max(1) + bias)
            if places:
                at.append(z.argmax(1))
        h = np.concatenate(found, 1)
        return np.maximum(h, 0), h, at

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows)[0] @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        parameters = [*self.tables, *self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        weight = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weight = (len(labels) / np.maximum(weight, 1) / len(self.languages))[labels]
        turn = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = windows[pick], labels[pick]
                h, raw, at = self.features(x, places=True)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= weight[pick, None] / len(y)
                back = (p @ self.out.T) * (raw > 0)
                grads: list[np.ndarray] = []
                for k, table in enumerate(self.tables):
                    g, own = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for place in range(len(table)):
                        np.add.at(g[place], (np.take_along_axis(x, at[k] + place, 1), np.arange(FILTERS)[None]), own)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(self.tables))]
                grads += [h.T @ p, p.sum(0)]
                turn += 1
                for q, g, (m, v) in zip(parameters, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of the text, the last padded with zero bytes."""
    padded = text + b"\0" * (-len(text) % size if text else size)
    return np.frombuffer(padded, np.uint8).reshape(-1, size)


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 400, windows: int = 6, most_documents: int = 25_600) -> ByteConvNet | None:
    """Train on documents with a language; ``usable`` says which may be learnt from. The documents of a language with
    the smallest identifier hashes are taken, per_language at most, fewer where all languages together would give more
    than most_documents, but one of each."""
    small_batches(docs.sparkSession)
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (usable if usable is not None else F.lit(True)))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    counts = some.groupBy("lang").agg(F.count("*").alias("n"), F.min(share).alias("least")).collect()  # one row a language
    per_language = max(1, min(per_language, most_documents // max(1, len(counts))))
    limit = F.create_map(*[F.lit(x) for r in counts for x in (str(r.lang), max(per_language / r.n, r.least + 1e-9))] or [F.lit(""), F.lit(0.0)])
    languages_seen = some.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), share.alias("share"), limit[F.col("lang").cast("string")].alias("limit"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "share": [], "windows": []}
            for lang, share, text in zip(batch.column("lang").to_pylist(), batch.column("share").to_pylist(), bytes_of(batch.column("text"))):
                every = windows_of(text)
                pick = np.random.default_rng(int(share * (1 << 40))).permutation(len(every))[:windows]
                out["lang"].append(lang)
                out["share"].append(share)
                out["windows"].append(every[np.sort(pick)].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("share", pa.float64()), ("windows", pa.binary())]))

    kept = languages_seen.where(F.col("share") < F.col("limit")).select("lang", "share", "text").mapInArrow(cut, "lang string, share double, windows binary").toPandas()
    if kept.empty:
        return None
    kept = kept.sort_values(["lang", "share", "windows"]).groupby("lang").head(per_language)
    languages = sorted(kept["lang"].unique())
    x = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in kept["windows"]])
    y = np.repeat([languages.index(lang) for lang in kept["lang"]], [len(w) // WINDOW for w in kept["windows"]])
    net = ByteConvNet(languages)
    net.train(x, y)
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, batch_windows: int = 128) -> DataFrame:
    """The documents' columns with lang_pred and score of every whole text; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    whole, lettered_ = fresh(docs, "_text", "_lettered")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if net:
            net.freeze()
        for batch in batches:
            texts = bytes_of(batch.column(whole))
            lettered = batch.column(lettered_).to_pylist()
            labels: list[str] = ["und"] * len(texts)
            scores = np.zeros(len(texts))
            ask = [i for i, t in enumerate(texts) if lettered[i]] if net else []
            cut = [windows_of(texts[i]) for i in ask]
            counts = [len(c) for c in cut]
            if ask:
                every = np.concatenate(cut)
                logs = np.concatenate([net.log_probabilities(every[i : i + batch_windows]) for i in range(0, len(every), batch_windows)])
                mean = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(counts)[:-1]])) / np.array(counts)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i, b in zip(ask, best):
                    labels[i] = net.languages[b]
                scores[ask] = p[np.arange(len(best)), best]
            give_back()
            rest = batch.select([n for n in batch.schema.names if n not in (whole, lettered_)])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(labels), pa.array(scores)], names=[*rest.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    asked = docs.withColumns({whole: F.col("text").cast("string"), lettered_: F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier's text leaves no rest by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
