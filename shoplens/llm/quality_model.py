"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each) and only the bag is labelled. Every passage is encoded: ratios of
its characters and words go through a tanh layer. Gated attention, tanh(V h) * sigmoid(U h), learns from the bags'
labels how much each passage counts; the weighted sum of the encoded passages is what is scored.

Training takes a bounded sample of labelled documents to the driver, as passage features, never as texts. Scoring
reads whole texts in parallel. Only characters and words enter a score: no id, language, source or label does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Words in a passage.
PASSAGE_WORDS = 64
#: Labelled documents that a model is fitted on at most.
SAMPLE = 4000
#: Characters that are encoded at once; longer texts are encoded in parts, cut at white space.
PART = 1 << 20
#: Kinds of characters that are counted.
LOWER, UPPER, DIGIT, BLANK, LINE_END, POINT, CRY, SYMBOL, OTHER = range(9)
KINDS = 9
#: Features of a passage.
FEATURES = 12


def _kind_table() -> np.ndarray:
    table = np.full(1 << 16, OTHER, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            table[code] = UPPER if char.isupper() else LOWER
        elif char.isdigit():
            table[code] = DIGIT
    for kind, chars in ((BLANK, " \t\x0b\x0c\r"), (LINE_END, "\n"), (POINT, ".,;:'\"()-"), (CRY, "!?"),
                        (SYMBOL, "#*$%&|<>")):
        table[[ord(c) for c in chars]] = kind
    return table


_KINDS: np.ndarray | None = None


def _kinds(codes: np.ndarray) -> np.ndarray:
    global _KINDS
    if _KINDS is None:
        _KINDS = _kind_table()
    return _KINDS[np.minimum(codes, 0xFFFF)]


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART:
        cut = text.rfind(" ", start + PART // 2, start + PART) + 1 or start + PART
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def _encode(text: str) -> np.ndarray:
    """Features of every passage of a part of a text; none for a part without words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds(codes)
    blank = (kinds == BLANK) | (kinds == LINE_END)
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(codes) else codes
    if not len(starts):
        return np.zeros((0, FEATURES))
    count = (len(starts) - 1) // PASSAGE_WORDS + 1
    word = np.zeros(len(codes), np.int64)
    word[starts] = 1
    word = np.maximum(np.cumsum(word) - 1, 0)
    table = np.bincount(word // PASSAGE_WORDS * KINDS + kinds, minlength=count * KINDS).reshape(count, KINDS).astype(float)
    passage = np.arange(len(starts)) // PASSAGE_WORDS
    words = np.bincount(passage, minlength=count).astype(float)
    # A number per word: a polynomial of its characters modulo 2^64, the same for equal words.
    place = np.arange(len(codes)) - starts[word]
    powers = np.uint64(0x9E3779B97F4A7C15) * (2 * np.clip(place, 0, 4095).astype(np.uint64) + np.uint64(1))
    named = np.add.reduceat(np.where(blank, 0, codes).astype(np.uint64) * (powers ^ (powers >> np.uint64(29))), starts)
    order = np.lexsort((named, passage))
    new = np.r_[True, (named[order][1:] != named[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    distinct = np.bincount(passage[order][new], minlength=count)
    again = np.bincount(passage[1:][(named[1:] == named[:-1]) & (passage[1:] == passage[:-1])], minlength=count)
    letters = np.maximum(table[:, LOWER] + table[:, UPPER], 1)
    solid = np.maximum(table.sum(axis=1) - table[:, BLANK] - table[:, LINE_END], 1)
    return np.column_stack([
        table[:, UPPER] / letters, letters / solid, table[:, DIGIT] / solid, table[:, OTHER] / solid,
        table[:, LINE_END] / words, table[:, POINT] / words, table[:, CRY] / words, table[:, SYMBOL] / words,
        np.minimum(solid / words, 40) / 10, distinct / words, again / words, np.log1p(words) / 4])


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage; a text without words is one passage of zeros."""
    found = [_encode(p) for p in _parts(text or "")]
    rows = found[0] if len(found) == 1 else np.concatenate(found)
    return rows if len(rows) else np.zeros((1, FEATURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Parameters by name, and the features' mean and spread."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """rows: passages of bags one after the other; starts: where each bag begins."""
        w, sizes = self.weights, np.diff(np.r_[starts, len(rows)])
        x = np.clip((rows - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        value, gate = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        raw = (value * gate) @ w["attend"]
        power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        share = power / np.repeat(np.add.reduceat(power, starts), sizes)
        bag = np.add.reduceat(h * share[:, None], starts, axis=0)
        return {"x": x, "h": h, "value": value, "gate": gate, "share": share, "bag": bag, "sizes": sizes,
                "score": _sigmoid(bag @ w["score"] + w["score0"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self.forward(np.concatenate(bags), starts)["score"]


def _gradients(model: AttentionModel, rows, starts, labels) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(rows, starts)
    error = (f["score"] - labels) / len(labels)
    out = {"score": f["bag"].T @ error, "score0": error.sum(keepdims=True)}
    to_bag = np.repeat(error[:, None] * w["score"], f["sizes"], axis=0)
    along = (to_bag * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["share"] * along, starts), f["sizes"])
    to_raw = f["share"] * (along - mean)
    out["attend"] = (f["value"] * f["gate"]).T @ to_raw
    both = to_raw[:, None] * w["attend"]
    to_value = both * f["gate"] * (1 - f["value"] ** 2)
    to_gate = both * f["value"] * f["gate"] * (1 - f["gate"])
    out["value"], out["gate"] = f["h"].T @ to_value, f["h"].T @ to_gate
    to_h = to_bag * f["share"][:, None] + to_value @ w["value"].T + to_gate @ w["gate"].T
    to_x = to_h * (1 - f["h"] ** 2)
    out["encode"], out["encode0"] = f["x"].T @ to_x, to_x.sum(axis=0)
    return out


def fit(bags: list[np.ndarray], labels: np.ndarray, width: int = 16, attention: int = 8, steps: int = 400,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 42) -> AttentionModel:
    """Fit by Adam on all bags at once. Without bags every document scores 1/2."""
    rng = np.random.default_rng(seed)
    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"encode": start(FEATURES, width), "encode0": np.zeros(width), "value": start(width, attention),
               "gate": start(width, attention), "attend": start(attention), "score": start(width), "score0": np.zeros(1)}
    if not bags:
        weights["score"] = np.zeros(width)
        return AttentionModel(weights, np.zeros(FEATURES), np.ones(FEATURES))
    rows, starts = np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags[:-1]])
    model = AttentionModel(weights, rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3))
    share = np.clip(np.mean(labels), 0.01, 0.99)
    weights["score0"][:] = np.log(share / (1 - share))
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for name, slope in _gradients(model, rows, starts, labels).items():
            slope = slope + decay * weights[name]
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.999 * second[name] + 0.001 * slope ** 2
            weights[name] -= (rate * first[name] / (1 - 0.9 ** step)
                              / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8))
    return model


def bucket(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text (0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample: int = SAMPLE, **settings) -> AttentionModel:
    """Fit on at most `sample` labelled documents outside bucket 0: those whose id has the smallest md5.

    Null labels and ids teach nothing. An id with several labels counts as 1 if any is. An id with several texts
    gives one bag per text.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias("_label")))
    chosen = (known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
              .withColumn("_bucket", bucket("_id")).where("_bucket <> 0")
              .orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample).select("_id", "_label"))

    @pandas_udf("array<float>")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([passages(t).astype(np.float32).ravel() for t in texts])

    found = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
             .select("_id", "_label", encoded("_text").alias("_rows")).toPandas())
    rows = [np.asarray(r, np.float32) for r in found["_rows"]]
    order = sorted(range(len(rows)), key=lambda k: (found["_id"].iloc[k], rows[k].tobytes()))
    bags = [rows[k].astype(float).reshape(-1, FEATURES) for k in order]
    return fit(bags, found["_label"].to_numpy(float)[order], **settings)


def scorer(model: AttentionModel):
    """A function of a text column: the score of each text, whole, between 0 and 1."""
    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values, held, size = [], [], 0
            for text in texts:
                held.append(passages(text))
                size += len(held[-1])
                if size >= 1 << 14:
                    values.append(model.scores(held))
                    held, size = [], 0
            yield pd.Series(np.concatenate([*values, model.scores(held)]))
    return score


def scored(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents with score and predicted (1 from the threshold on); columns of these names are replaced.

    A null text counts as empty and gets the score of a passage of zeros. Repeated rows get equal scores; an empty
    table stays empty.
    """
    return (docs.drop("score", "predicted").withColumn("score", scorer(model)(F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def accepted(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the model does not reject, with their own columns only."""
    return docs.where(scorer(model)(F.col(text_col)) >= threshold)
