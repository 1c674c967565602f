"""Quality classifier by co-training.

Two views of a document are learnt apart: its text (shape of words, repetition, classes of characters) and the metadata
of its page (source, language, stated length, layout of lines; no word enters it).  Each starts from the labelled rows.
In every round each view scores all unlabelled documents, and all those it is confident of join the other view's
training rows with the label it gave them.  At the end both views are calibrated on labelled rows kept apart and
combined there; the combination scores every document.

Labelled rows are bounded: at most ``FIT_ROWS`` of them, chosen by hash, are fitted on the driver.  Pseudo-labelled rows are not:
every Newton step sums gradient and curvature over all of them in the tasks.  Those of a class weigh ``WEIGHT`` times the
labelled rows of the class together, so the balance is the same at any number of documents."""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, settle

FIT_ROWS = 20_000
WEIGHT = 0.5  # of all pseudo-labelled rows of a class, as a share of its labelled rows
ROUNDS = 2
RIDGE = 1.0
STEPS = 3  # Newton steps over pseudo-labelled rows, from the fit before
CONFIDENT = 0.97
BINS = 12  # each feature is cut at quantiles of the fitting rows
SOURCES = 64  # buckets that sources are hashed to

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _SPACE[[9, 10, 11, 12, 13, 32]] = True, True, True, True
_HIGH = np.arange(256) > 127
_STOP = np.isin(np.arange(256), list(b".,;:?'\"-()"))
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP)
TEXT_WIDTH, META_WIDTH = 15, 7


def text_view(text: str | None) -> list[float]:
    """Features of the text; an empty or null text has none of anything."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum() + count[_HIGH].sum()))
    low = [w.lower() for w in words]
    repeats = sum(map(bytes.__eq__, low, low[1:]))
    marks = int(count[_MARK].sum())
    p = count[count > 0] / n
    return [
        np.log1p(len(words)),
        len(set(low)) / m / (1 + np.log(m)) if words else 0.0,
        len(set(low)) / m,
        repeats / m,
        sum(map(len, words)) / m,
        float(count[_UPPER].sum()) / letters,
        float(count[_DIGIT].sum()) / n,
        marks / n,
        marks / m,
        float(count[33] + count[63]) / m,
        float(count[124]) / m,
        float(count[46] + count[44]) / m,
        letters / n,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        float(raw.count(b"http") + raw.count(b"@")) / m,
    ]


def meta_view(text: str | None, lang: str | None, source: str | None, stated: float | None) -> list[float]:
    """Features of the page: hashed source and language, stated length, and how its lines are laid out."""
    import zlib

    lines = (text or "").split("\n")
    sizes = [len(x) for x in lines]
    full = max(1, sum(1 for s in sizes if s))
    return [
        float(zlib.crc32((source or "").encode()) % SOURCES) if source is not None else -1.0,
        float(zlib.crc32((lang or "").encode()) % SOURCES) if lang is not None else -1.0,
        np.log1p(max(0.0, float(stated))) if stated is not None and stated == stated else -1.0,
        np.log1p(len(lines)),
        np.log1p(sum(sizes) / full),
        len(set(lines)) / len(lines),
        sum(1 for s in sizes if not s) / len(lines),
    ]


class View:
    """Additive logistic model over quantile bins of each feature (two hashed features are categories)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, categories: tuple[int, ...] = ()):
        self.cuts = [np.unique(np.floor(x[:, j]) + 0.5) if j in categories else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.beta = _logistic(self.bins(x), y)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(x), 1 + sum(len(c) + 1 for c in self.cuts)), dtype=np.float32), 1
        out[:, 0] = 1
        for j, c in enumerate(self.cuts):
            out[np.arange(len(x)), at + np.searchsorted(c, x[:, j], side="right")] = 1
            at += len(c) + 1
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bins(x) @ self.beta if len(x) else np.zeros(0)


def _slope(a: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted log likelihood at ``beta``."""
    p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
    return a.T @ (weight * (y - p)), (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a


def _newton(beta: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The next point of a ridge logistic regression; the first column, the intercept, is barely shrunk."""
    shrink = np.full(len(beta), ridge)
    shrink[0] = 1e-3
    return beta + np.linalg.solve(h + np.diag(shrink), g - shrink * beta)


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    a, beta = a.astype(np.float64), np.zeros(a.shape[1])
    for _ in range(rounds):
        last, beta = beta, _newton(beta, *_slope(a, y, np.ones(len(y)), beta), ridge)
        if np.abs(beta - last).max() < 1e-6:
            break
    return beta


class Model:
    """Both views, their calibrations, and the combination."""

    def __init__(self, views: list[View], calibration: list[np.ndarray], mix: np.ndarray):
        self.views, self.calibration, self.mix = views, calibration, mix

    def scores(self, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Calibrated probability of each view, and of both together."""
        z = [np.clip(c[0] + c[1] * v.logit(x), -30, 30) for v, c, x in zip(self.views, self.calibration, (text, meta), strict=True)]
        both = np.clip(self.mix[0] + self.mix[1] * z[0] + self.mix[2] * z[1], -30, 30)
        return [1 / (1 + np.exp(-x)) for x in (*z, both)]


def _combine(views: list[View], held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    """held: labelled rows kept apart, (text, meta, labels)."""
    one = np.ones(len(held[2]))
    z = [v.logit(x) for v, x in zip(views, held[:2], strict=True)]
    calibration = [_logistic(np.stack([one, x], axis=1), held[2], 0.1) for x in z]
    z = [np.clip(c[0] + c[1] * x, -30, 30) for c, x in zip(calibration, z, strict=True)]
    return Model(views, calibration, _logistic(np.stack([one, *z], axis=1), held[2], 0.1))


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch with columns text, lang, source, n_chars, by name."""
    col = {n: b.column(b.schema.get_field_index(n)) for n in ("text", "lang", "source", "n_chars") if n in b.schema.names}
    texts = [t.as_py() for t in col["text"]]
    pick = lambda n: col[n].to_pylist() if n in col else [None] * len(texts)
    text = np.array([text_view(t) for t in texts], dtype=np.float64).reshape(-1, TEXT_WIDTH)
    meta = np.array([meta_view(*r) for r in zip(texts, pick("lang"), pick("source"), pick("n_chars"), strict=True)], dtype=np.float64).reshape(-1, META_WIDTH)
    return text, meta


def _inputs(docs: DataFrame) -> list:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [F.col(c).cast(k).alias(c) for c, k in kinds.items() if c in docs.columns]


def view_table(docs: DataFrame) -> DataFrame:
    """doc_id and v, the features of both views, for every row of ``docs``."""

    def run(batches):
        for b in batches:
            v = np.concatenate(_views(b), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["doc_id", "v"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).mapInArrow(run, "doc_id long, v array<float>")


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    v = np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, TEXT_WIDTH + META_WIDTH)
    return v[:, :TEXT_WIDTH], v[:, TEXT_WIDTH:]


def _score_table(views: DataFrame, model: Model) -> DataFrame:
    """doc_id, v, text_score, meta_score, score."""

    def run(batches):
        for b in batches:
            v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(-1, TEXT_WIDTH + META_WIDTH)
            s = model.scores(v[:, :TEXT_WIDTH], v[:, TEXT_WIDTH:])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, s)], names=["doc_id", "v", "text_score", "meta_score", "score"])

    return views.select("doc_id", "v").mapInArrow(run, "doc_id long, v array<float>, text_score double, meta_score double, score double")


TEACHERS = ("meta_score", "text_score")  # of the text view, and of the metadata view
COLUMNS = (slice(0, TEXT_WIDTH), slice(TEXT_WIDTH, None))


def _pseudo_sums(scored: DataFrame, views: list[View], weights: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view, gradient and curvature at its coefficients over all rows that its teacher is confident of; ``weights`` of a row
    labelled 0 and 1.  Tasks send one sum each, which a few tasks add up for the driver."""
    wide = [len(v.beta) for v in views]
    size = sum(w + w * w for w in wide)

    def run(batches):
        sums = [(np.zeros(w), np.zeros((w, w))) for w in wide]
        for b in batches:
            for k, view in enumerate(views):
                s = b.column(1 + k).to_numpy(zero_copy_only=False)
                at = np.flatnonzero((s >= CONFIDENT) | (s <= 1 - CONFIDENT))
                x = np.asarray(b.column(0).take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, TEXT_WIDTH + META_WIDTH)[:, COLUMNS[k]]
                y = (s[at] >= CONFIDENT).astype(np.float64)
                for i in range(0, len(at), 8192):
                    part = slice(i, i + 8192)
                    dg, dh = _slope(view.bins(x[part]).astype(np.float64), y[part], np.where(y[part] > 0, weights[k][1], weights[k][0]), view.beta)
                    sums[k] = sums[k][0] + dg, sums[k][1] + dh
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x.tobytes() for s in sums for x in s)], pa.binary())], names=["sums"])

    def total(parts) -> np.ndarray:
        return sum((np.frombuffer(bytes(p)) for p in parts), np.zeros(size))

    def add(batches):
        yield pa.RecordBatch.from_arrays([pa.array([total(x.as_py() for b in batches for x in b.column(0)).tobytes()], pa.binary())], names=["sums"])

    parts = scored.select("v", *TEACHERS).mapInArrow(run, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()
    whole, out, at = total(r[0] for r in parts), [], 0
    for w in wide:
        out.append((whole[at : at + w], whole[at + w : at + w + w * w].reshape(w, w)))
        at += w + w * w
    return out


def co_train(views: DataFrame, labels: DataFrame, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model for ``views`` (see ``view_table``) and ``labels`` (doc_id, quality); None where labels lack a class.

    Null labels and doc_ids are ignored; a doc_id labelled more than once takes the label of most of its rows, 1 on ties."""
    y = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    known = views.join(y, F.col("doc_id") == F.col("_d"))
    rows = hash_sample(known.select("v", "y", "doc_id").distinct(), ["doc_id", "v"], fit_rows)
    apart = np.arange(len(rows)) % 4 == 0
    x, t = _matrix(rows), np.array([r["y"] for r in rows], dtype=np.float64)
    if min(sum(t[apart]), sum(1 - t[apart]), sum(t[~apart]), sum(1 - t[~apart])) < 1:
        return None
    held = (x[0][apart], x[1][apart], t[apart])
    own, mine = [v[~apart] for v in x], t[~apart]
    model = _combine([View(own[0], mine), View(own[1], mine, (0, 1))], held)
    if not rounds:
        return model
    free = settle(views.join(y, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti"), shuffled=True)
    own_bins = [v.bins(z).astype(np.float64) for v, z in zip(model.views, own, strict=True)]
    for _ in range(rounds):
        scored = settle(_score_table(free, model))
        sure = scored.agg(*[F.count_if(c) for k in TEACHERS for c in (F.col(k) <= 1 - CONFIDENT, F.col(k) >= CONFIDENT)]).head()
        weights = [tuple(WEIGHT * float(c) / max(1, sure[2 * i + j]) for j, c in enumerate((sum(1 - mine), sum(mine)))) for i in range(2)]
        views = [copy.copy(v) for v in model.views]
        for _ in range(STEPS):
            sums = _pseudo_sums(scored, views, weights)
            for v, a, (g, h) in zip(views, own_bins, sums, strict=True):
                dg, dh = _slope(a, mine, np.ones(len(mine)), v.beta)
                v.beta = _newton(v.beta, g + dg, h + dh, RIDGE)
        model = _combine(views, held)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source, n_chars): doc_id, text_score, meta_score, score, keep.

    Scores are calibrated probabilities of good quality.  Null texts, metadata and doc_ids are scored like any other
    value; repeated rows are kept.  Without labels of both classes every score is null and every document is kept.  An
    empty table gives an empty result; other columns are ignored."""
    views = settle(view_table(docs))
    model = co_train(views, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return views.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("keep"))
    return _score_table(views, model).drop("v").withColumn("keep", F.col("score") >= threshold)


def filter_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, unchanged; scored as they pass, without a shuffle of texts.

    Nulls, repeated rows and missing labels are treated as there; other columns stay."""
    model = co_train(settle(view_table(docs)), labels)
    if model is None:
        return docs

    def run(batches):
        for b in batches:
            good = model.scores(*_views(b))[2] >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
