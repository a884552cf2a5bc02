"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages over its whole text.  Every passage is encoded, a gated attention (tanh times sigmoid) gives it
a weight among the passages of its document, and the weighted sum is scored; encoder, attention and score are learnt together
from document labels alone.

The fit takes labelled documents, those whose hashed ids come first, ``FIT_DOCUMENTS`` at most and as long as their passages are
``FIT_PASSAGES`` at most all told, so the fit's input is bounded by rows left out of it; it uses all passages of each, as scores do
of all documents.

Defined cases: a blank or null text is one passage without words and gets a score; labels other than 0 and 1 and labels of
null ids are ignored; of conflicting labels the lower counts; repeated rows are fitted once and scored each; without labels of both
kinds the score is their share (0.5 without any); extra columns pass through, a clashing result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of
from tidewatch.llm.passages import DIMENSIONS, encode
from tidewatch.session import materialize

FIT_DOCUMENTS = 3_000
FIT_PASSAGES = 400_000
ENCODED, GATES = 16, 8
STEPS, BATCH, RATE, DECAY = 900, 256, 0.01, 1e-4
THRESHOLD = 0.7
#: Share of a full passage at which its shares of bytes and words count for half as much as those of a full one, relative to their
#: limit: the few words of a short passage say little about them.
LEAN = 0.25


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.weights:
            return np.full(len(bags), float(self.mean[0]))
        return _forward(self.weights, _standard(np.concatenate(bags), self.mean, self.scale), _starts(bags))["p"]


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised passages, those with few words drawn towards the mean."""
    fullness = np.clip(x[:, -2:-1], 0.0, 1.0)
    out = (x - mean) / scale
    out[:, :-2] *= fullness * (1 + LEAN) / (fullness + LEAN)
    return out


def _starts(bags: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    sizes = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "p": _sigmoid(z @ w["score"] + w["score_b"][0])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    miss = (f["p"] - y) / len(y)
    spread = np.repeat(miss, f["sizes"])
    toward = spread[:, None] * w["score"]  # of the weighted sum, per passage
    da = (toward * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
    dt = de[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * toward + dt @ w["value"].T + dg @ w["gate"].T
    du = dh * (1 - f["h"] ** 2)
    return {"encode": x.T @ du, "encode_b": du.sum(axis=0), "value": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ de,
            "score": f["z"].T @ miss, "score_b": np.array([miss.sum()])}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5, steps: int = STEPS) -> Model:
    """Adam on the log loss; the same bags in the same order give the same model."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.array([share]), np.ones(1), {})
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [_standard(b, mean, scale) for b in bags]
    shapes = {"encode": (DIMENSIONS, ENCODED), "encode_b": (ENCODED,), "value": (ENCODED, GATES), "gate": (ENCODED, GATES), "attend": (GATES,), "score": (ENCODED,), "score_b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (k not in ("encode_b", "score_b")) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(bags), min(BATCH, len(bags)))
        chosen = [bags[i] for i in pick]
        grads = _gradients(w, np.concatenate(chosen), _starts(chosen), labels[pick])
        for k, grad in grads.items():
            grad = grad + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _encoded(rows: DataFrame) -> DataFrame:
    """(id, bag): the passages of each text as bytes of float32."""
    def run(batches):
        for batch in batches:
            bags = [encode(t.as_buffer().to_pybytes()).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bags, pa.binary())], names=["id", "bag"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bag binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", documents: int = FIT_DOCUMENTS, passages: int = FIT_PASSAGES) -> Model:
    """Model from the labelled rows that are not held out.

    Documents come in the order of their hashed ids; one that would take the passages beyond ``passages`` is left out.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(documents)
    chosen = sample.sparkSession.createDataFrame(sample.collect(), sample.schema)  # ``documents`` rows at most
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    bags = materialize(_encoded(rows).groupBy("id").agg(F.min("bag").alias("bag")).join(F.broadcast(chosen), "id"), "bags")
    left, taken = passages, []
    for r in bags.select("id", (F.length("bag") / (4 * DIMENSIONS)).cast("bigint").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if r.n <= left:
            left -= r.n
            taken.append(r.id)
    fitted = bags.where(F.col("id").isin(taken)).orderBy("id").collect()
    return fit_bags([np.frombuffer(r.bag, dtype="<f4").reshape(-1, DIMENSIONS).astype(np.float64) for r in fitted], np.array([r.y for r in fitted]))


def scorer(model: Model):
    """Column function: text to score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            bags = [encode(t.as_buffer().to_pybytes()) for t in texts[at : at + 256]]
            out.append(model.scores(bags))
        return pa.array(np.concatenate(out) if out else np.array([], dtype=np.float64))

    return score


def with_scores(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns plus score and predicted (1 where the score reaches the threshold)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"score", "predicted"}]
    scored = docs.select(*kept, scorer(model)(text_of(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return docs.where(scorer(model)(text_of(text)) >= threshold)
