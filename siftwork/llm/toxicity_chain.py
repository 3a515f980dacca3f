"""A chain of linear classifiers over toxicity categories."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, quoted, texts_of, word_hashes
from .text_features import bounded_sample, logistic

_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


#: Bytes of a stem: words of one stem share a feature, so that a few labelled texts tell of words that none of them has.
_STEM, _STEMS = 6, np.uint64(0x5851F42D4C957F2D)


def distinct_words(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct words of a whole text, in lower case and split at whatever in ASCII isn't a letter or digit, and of the stems of longer ones."""
    plain = text.lower().encode().translate(_PUNCTUATION)
    words, lengths = word_hashes(plain)
    stems = word_hashes(plain, _STEM)[0][lengths > _STEM]
    return distinct(np.concatenate([words, stems ^ _STEMS]))


@dataclass
class Link:
    """One category's model: a bias, weights of words and stems, and weights of the earlier categories' log odds."""

    category: str
    keys: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5

    def probability(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        """earlier: a column of probabilities for each earlier category."""
        z = self.bias + log_odds(earlier) @ self.earlier
        if len(self.keys):
            for i, words in enumerate(docs):
                if len(words):
                    at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
                    z[i] += self.weights[at[self.keys[at] == words]].sum()
        return logistic(z)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_link(category: str, docs: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, features: int = 2000, least_docs: int = 4, ridge: float = 2e-3, rounds: int = 150) -> Link:
    """Logistic regression over the presence of the words that tell most, by their chi-square with the category, in least_docs texts at least."""
    n, pos = len(docs), float(y.sum())
    bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    blank = Link(category, np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), bias)
    if pos in (0.0, float(n)):
        return blank
    words = np.concatenate(docs)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    keys, back, times = np.unique(words, return_inverse=True, return_counts=True)
    a = np.bincount(back, weights=y[row], minlength=len(keys))
    expect = times * pos / n
    chi = (a - expect) ** 2 / (expect * (1 - times / n) + 1e-9)
    chi[times < least_docs] = 0
    best = np.sort(np.lexsort((keys, -chi))[:features])
    best = best[chi[best] > 15.1]  # the 0.01 % point: a sample has tens of thousands of words
    slot = np.full(len(keys), -1)
    slot[best] = np.arange(len(best))
    hit = slot[back] >= 0
    col, row = slot[back][hit], row[hit]
    x = log_odds(earlier)
    w, v, b = np.zeros(len(best)), np.zeros(earlier.shape[1]), bias
    gw, gv, gb = np.full(len(best), 1e-4), np.full(len(v), 1e-4), 1e-4
    for _ in range(rounds):  # AdaGrad on the whole sample
        err = (logistic(b + np.bincount(row, weights=w[col], minlength=n) + x @ v) - y) / n
        dw, dv, db = np.bincount(col, weights=err[row], minlength=len(w)) + ridge / n * w, x.T @ err + ridge / n * v, err.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - 0.3 * dw / np.sqrt(gw), v - 0.3 * dv / np.sqrt(gv), b - 0.3 * db / gb**0.5
    return Link(category, keys[best], w, v, float(b))


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, categories: list[str], folds: int = 3) -> list[Link]:
    """A link for each category, in order. Later links learn from out-of-fold probabilities of the earlier ones.

    Each link's threshold is where its own out-of-fold F1 is highest, so that it is set on probabilities of unseen texts.
    """
    n = len(docs)
    earlier, chain = np.zeros((n, 0)), []
    fold = np.arange(n) % folds
    for k, category in enumerate(categories):
        y = labels[:, k].astype(float)
        out = np.zeros(n)
        for f in range(folds):
            learn, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(rest):
                m = fit_link(category, [docs[i] for i in learn], y[learn], earlier[learn])
                out[rest] = m.probability([docs[i] for i in rest], earlier[rest])
        link = fit_link(category, docs, y, earlier)
        if n:
            order = np.argsort(-out, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, n + 1) + max(1.0, y.sum()))
            last = int(np.argmax(f1))
            after = out[order[last + 1]] if last + 1 < n else 0.0
            link.threshold = float(np.clip((out[order[last]] + after) / 2, 0.05, 0.95))
        chain.append(link)
        earlier = np.column_stack([earlier, out])
    return chain


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", most: int = 9000) -> list[Link]:
    """Fits the chain on most labelled documents at most (a bounded sample, see bounded_sample); word hashes come to the driver, not texts."""
    import pyarrow as pa

    sample = bounded_sample(docs, labels, id_col, text_col, categories, most)
    kind = sample.schema["id"].dataType.simpleString()

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([distinct_words(t).tobytes() for t in texts_of(batch.column(1))], pa.binary()), batch.column(2)], ["id", "words", "y"])

    sent = sample.select("id", "text", F.array(*[quoted(c).cast("int") for c in categories]).alias("y")).mapInArrow(features, f"id {kind}, words binary, y array<int>")
    rows = sorted(((r["id"], bytes(r["words"]), r["y"]) for r in sent.toLocalIterator()), key=lambda r: r[0])
    return fit_chain([np.frombuffer(r[1], np.uint64) for r in rows], np.array([r[2] for r in rows], float).reshape(len(rows), len(categories)), categories)


def score_toxicity(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., is_<category>...): each row's probabilities along the chain, over the whole text; null text: empty.

    The id column keeps its name; other columns are not read, so they can't clash. Equal texts get equal results.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [link.category for link in chain]

    def scored(batches):
        for batch in batches:
            docs = [distinct_words(t) for t in texts_of(batch.column(1))]
            p = np.zeros((len(docs), 0))
            for link in model.value:
                p = np.column_stack([p, link.probability(docs, p)])
            flags = [pa.array(p[:, k] >= link.threshold) for k, link in enumerate(model.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), *flags], ["id", *(f"p_{c}" for c in names), *(f"is_{c}" for c in names)])

    out = docs.select(quoted(id_col), quoted(text_col).cast("string")).mapInArrow(scored, ", ".join([f"id {kind}", *(f"`p_{c}` double" for c in names), *(f"`is_{c}` boolean" for c in names)]))
    return out.withColumnRenamed("id", id_col)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents. The labels table has one toxicity category, so the chain's earlier link is the other label, bad quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    out = score_toxicity(docs, train_toxicity(docs, labels, ["junk", "toxic"]))
    return out.select("doc_id", F.col("p_junk").alias("junk_probability"), F.col("p_toxic").alias("score"), F.col("is_toxic").cast("int").alias("predicted"), F.col("is_toxic").alias("toxic"))
