"""Quality by co-training: a classifier of the text and one of the page data teach each other, then judge together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import ROW, Scratch, arrow_pass
from gleaner.llm.quality_rules import SYMBOLS, symbols

SAMPLE = 12_000  # labelled rows, and pseudo-labelled ones of each class and view, that a fit takes at most
ROUNDS = 3
CONFIDENT = 0.97  # calibrated probability from which a view lends its label to the other one
FOLDS = 5  # one part in FOLDS of the labelled sample is kept from the fit, for calibration
RIDGE = 1.0
SOURCES, LANGS = 32, 16  # hash buckets of the page data

TEXT_VIEW = SYMBOLS + 9
PAGE_VIEW = SOURCES + LANGS + 4


def text_features(text: str) -> np.ndarray:
    """What the whole text is made of: symbol shares, repetition and word shapes. Empty texts give zeros."""
    out = np.zeros(TEXT_VIEW)
    found = symbols(text)
    if not len(found):
        return out
    out[:SYMBOLS] = np.sqrt(np.bincount(found, minlength=SYMBOLS) / len(found))
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    if words:
        n = len(words)
        ends = [w[-1] for w in words]
        out[SYMBOLS:] = (
            len(set(words)) / n,
            len(set(zip(words, words[1:]))) / max(1, n - 1),
            len(set(lines)) / max(1, len(lines)),
            sum(e in "#*$%&|<>@~^" for e in ends) / n,
            sum(e in "!?" for e in ends) / n,
            sum(w.isupper() for w in words) / n,
            sum(any(c.isdigit() for c in w) for w in words) / n,
            sum(map(len, words)) / n / 10,
            np.log1p(n) / 10,
        )
    return out


def page_features(source: str | None, lang: str | None, n_chars: int | None, lines: int) -> np.ndarray:
    """Where a document is from and how it is laid out, not what it says. Nulls have buckets of their own."""
    out = np.zeros(PAGE_VIEW)
    out[xxhash.xxh32_intdigest(repr(source)) % SOURCES] = 1
    out[SOURCES + xxhash.xxh32_intdigest(repr(lang)) % LANGS] = 1
    size = max(0, n_chars or 0)
    out[SOURCES + LANGS :] = (np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / max(1, lines)) / 10, n_chars is None)
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, and Platt scaling on rows kept from the fit."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of good quality."""
        raw = x @ self.weights[:-1] + self.weights[-1]
        return self.slope * raw + self.shift


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Logistic:
    """With one class only, or no rows, the classifier says what share of rows is good and nothing else."""
    n = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Logistic(np.append(np.zeros(n), np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    standard = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = _newton(standard, y, np.append(np.full(n, RIDGE), 0.0))
    weights = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    model = Logistic(weights)
    if len(held_y) and held_y.min() < held_y.max():
        raw = model.logit(held_x)
        # Platt's targets keep the scaled odds finite where the classes part cleanly.
        good, bad = (held_y == 1).sum(), (held_y == 0).sum()
        target = np.where(held_y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        slope, shift = _newton(np.stack([raw, np.ones(len(raw))], axis=1), target, np.array([1e-3, 1e-3]))
        if slope > 0:
            model.slope, model.shift = float(slope), float(shift)
    return model


def feature_table(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(doc_id, text_hash, text_view, page_view) of every row, from whole texts."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes, *rest = batch.columns
        texts, sources, langs, sizes = (c.to_pylist() for c in rest)
        texts = [t or "" for t in texts]
        by_text = np.stack([text_features(t) for t in texts])
        by_page = np.stack([page_features(s, g, n, t.count("\n") + 1) for s, g, n, t in zip(sources, langs, sizes, texts)])
        return pa.RecordBatch.from_arrays([ids, hashes, _lists(by_text), _lists(by_page)], names)

    names = ["doc_id", "text_hash", "text_view", "page_view"]
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    rows = docs.select(*[F.col(columns[c]).cast(kind).alias(c) for c, kind in kinds.items()])
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "source", "lang", "n_chars")
    return arrow_pass(rows, make, "doc_id long, text_hash long, text_view array<float>, page_view array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.float32).ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _scores(features: DataFrame, text: Logistic, page: Logistic) -> DataFrame:
    """All rows with the calibrated log odds of both views."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_text, by_page = _matrix(batch.column(2), TEXT_VIEW), _matrix(batch.column(3), PAGE_VIEW)
        columns = [*batch.columns[:2], pa.array(text.logit(by_text)), pa.array(page.logit(by_page))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "text_logit", "page_logit"])

    schema = "doc_id long, text_hash long, text_logit double, page_logit double"
    return arrow_pass(features.select("doc_id", "text_hash", "text_view", "page_view"), score, schema)


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Views and labels of at most `most` rows, those with the lowest hashes; a task keeps no more than these."""
    chosen = rows.orderBy(F.xxhash64(F.lit(42), "doc_id", "text_hash"), "doc_id", "text_hash").limit(most)
    table = chosen.select("text_view", "page_view", F.col("label").cast("double").alias("label")).toArrow().combine_chunks()
    views = [_matrix(table.column(i).combine_chunks(), w) if len(table) else np.zeros((0, w)) for i, w in ((0, TEXT_VIEW), (1, PAGE_VIEW))]
    return views[0], views[1], table.column(2).to_numpy()


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    columns: dict[str, str] | None = None,
    label_col: str = "quality",
    rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, text_hash, text_score, page_score, score, kept) of every row of docs.

    labels has (doc_id, label_col 0 or 1); null labels and ids are passed over, and of several labels of a
    document the lowest counts. Each round scores all documents with both classifiers; what one is confident
    of (calibrated probability of at least CONFIDENT) among documents without a label becomes a label for
    the other. Fits take a bounded sample (SAMPLE) of the labelled and of each kind of pseudo-labelled rows;
    features, scores and the choice of pseudo-labels cover all rows. The views' calibrated odds are combined
    as independent evidence, and a document is kept from even odds on.

    Null and empty texts are scored by what their page data say and an all-zero text view; other nulls have
    values of their own. Repeated rows are scored alike and returned as often as they come. Without labels
    of both kinds all scores are one half and everything is kept. An empty table gives no rows.
    """
    columns = {c: c for c in ("doc_id", "text", "source", "lang", "n_chars")} | (columns or {})
    scratch = Scratch(docs.sparkSession, "cotraining")
    features = scratch.keep(feature_table(docs, columns))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = features.join(known, "doc_id")
    text_x, page_x, y = _sample(labelled, SAMPLE)
    held = np.arange(len(y)) % FOLDS == 0
    trained = bool(len(y)) and y.min() < y.max()
    prior = float(np.log(y.sum() / (len(y) - y.sum()))) if trained else 0.0
    extra = {v: (np.zeros((0, w)), np.zeros(0)) for v, w in (("text", TEXT_VIEW), ("page", PAGE_VIEW))}
    for turn in range(rounds):
        views = []
        for view, x in (("text", text_x), ("page", page_x)):
            more_x, more_y = extra[view]
            fit_x, fit_y = np.vstack([x[~held], more_x]), np.concatenate([y[~held], more_y])
            views.append(fit_logistic(fit_x, fit_y, x[held], y[held]))
        text, page = views
        if turn == rounds - 1 or not trained:
            break
        scored = _scores(features, text, page).join(known, "doc_id", "left_anti").distinct()
        scored = scratch.keep(scored)
        bound = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        for teacher, learner, at in (("text", "page", 1), ("page", "text", 0)):
            logit = F.col(f"{teacher}_logit")
            found = []
            for label, sure in ((1, logit >= bound), (0, logit <= -bound)):
                chosen = scored.where(sure).select("doc_id", "text_hash", F.lit(label).alias("label"))
                same = features["doc_id"].eqNullSafe(chosen["doc_id"]) & features["text_hash"].eqNullSafe(chosen["text_hash"])
                rows = chosen.orderBy(F.xxhash64(F.lit(42), "doc_id", "text_hash")).limit(SAMPLE // 2)
                rows = features.join(rows, same).drop(chosen["doc_id"]).drop(chosen["text_hash"])
                found.append(_sample(rows, SAMPLE // 2))
            extra[learner] = (np.vstack([f[at] for f in found]), np.concatenate([f[2] for f in found]))
    logits = _scores(features, text, page)
    probability = lambda z: 1 / (1 + F.exp(-z))
    both = F.col("text_logit") + F.col("page_logit") - F.lit(prior) if trained else F.lit(0.0)
    return logits.select(
        "doc_id",
        "text_hash",
        probability(F.col("text_logit")).alias("text_score"),
        probability(F.col("page_logit")).alias("page_score"),
        probability(both).alias("score"),
        (both >= 0).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps."""
    names = {"doc_id": "doc_id", "text": "text"} | (columns or {})
    scores = quality_scores(docs, labels, columns).where("NOT kept").select("doc_id", "text_hash").distinct()
    scores = scores.withColumnsRenamed({"doc_id": "_bad_id", "text_hash": "_bad_hash"})
    scores = Scratch(docs.sparkSession, "rejected").keep_small(scores)
    rows = docs.select(
        F.struct("*").alias(ROW),
        F.col(names["doc_id"]).cast("long").alias("_id"),
        F.xxhash64(F.col(names["text"]).cast("string")).alias("_hash"),
    )
    same = F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash"))
    return rows.join(scores, same, "left_anti").select(f"{ROW}.*")
