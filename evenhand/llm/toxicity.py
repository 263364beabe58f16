"""Toxicity by compression: windows cost fewer bytes under the dictionary of their own kind."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.labels import class_weights, fold, training_sample
from evenhand.llm.registry import query, table, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

WINDOW = 100  # bytes, extended to the next space
SAMPLE = 2_500  # training documents of each class
BASE_BYTES, OWN_BYTES, LEAD_BYTES = 100_000, 16_384, 200
GRAMS = (6, 8)  # lengths of the byte runs that tell texts apart
MIN_SHARE, MIN_LIFT = 0.02, 15.0
SAVED = 3  # bytes by which a window counts as toxic


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in pieces of `size` bytes up to the next space, or twice `size` without one."""
    out, start = [], 0
    while start < len(text):
        end = text.find(b" ", start + size, start + 2 * size)
        if end < 0:
            end = min(len(text), start + 2 * size)
        out.append(text[start:end])
        start = end + (text[end:end + 1] == b" ")
    return out


def grams(text: bytes, length: int) -> np.ndarray:
    """The distinct runs of `length` bytes (8 at most), as numbers."""
    if len(text) < length:
        return np.array([], np.uint64)
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) - length + 1, np.uint64)
    for k in range(length):
        out = (out << np.uint64(8)) | raw[k:len(raw) - length + 1 + k]
    return np.unique(out)


def telling_grams(toxic: list[bytes], ordinary: list[bytes], length: int) -> set[int]:
    """Byte runs in a due share of the toxic texts and over MIN_LIFT times rarer in the ordinary ones."""
    found, times = np.unique(np.concatenate([grams(t, length) for t in toxic]), return_counts=True)
    often = times >= max(3, MIN_SHARE * len(toxic))
    found, times = found[often], times[often]
    there = np.zeros(len(found), np.int64)
    for t in ordinary:
        there += np.isin(found, grams(t, length), assume_unique=True)
    return set(found[times / len(toxic) > MIN_LIFT * (there + 0.5) / max(len(ordinary), 1)].tolist())


def telling_runs(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Telling words and the stretches of words that telling byte runs cover, longest first, none inside another."""
    known = {n: telling_grams(toxic, ordinary, n) for n in GRAMS}
    runs: Counter = Counter()
    words = Counter(w for t in toxic for w in set(t.split()))
    there = Counter(w for t in ordinary for w in set(t.split()) if w in words)
    for word, times in words.items():
        spaced = b" " + word + b" "
        rare = times / len(toxic) > MIN_LIFT * (there[word] + 0.5) / max(len(ordinary), 1)
        whole = rare and times >= max(3, MIN_SHARE * len(toxic)) and len(spaced) >= GRAMS[0]
        covered = np.full(len(spaced) + 1, whole)
        covered[-1] = False
        for n, marks in known.items():
            for k in range(len(spaced) - n + 1):
                if int.from_bytes(spaced[k:k + n]) in marks:
                    covered[k:k + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered])))
        for start, end in zip(edges[::2], edges[1::2]):
            runs[spaced[start:end]] += times
    kept: list[bytes] = []
    for run in sorted((r for r, n in runs.items() if n >= 2), key=lambda r: (-len(r), r)):
        if not any(run in longer for longer in kept):
            kept.append(run)
    return kept


def filled(parts: list[bytes], limit: int) -> bytes:
    out = bytearray()
    for part in parts:
        if len(out) + len(part) + 1 > limit:
            break
        out += part if part.startswith(b" ") else b" " + part
    return bytes(out)


@dataclass
class Model:
    """Two dictionaries with a common base, a lead, and the calibration of the window statistics."""

    toxic: bytes
    ordinary: bytes
    lead: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Raw-content dictionaries of toxic and ordinary text, and a lead for every window.

    Both end in the most frequent words of ordinary text, so that ordinary wording costs the same
    under both. Before it each has text of its own: the stretches that tell toxic text apart, and as
    much ordinary wording. The lead is a piece of the base: with it a window of any length is
    compressed, never stored as it is.
    """
    words = Counter(w for t in ordinary for w in set(t.split()))
    usual = [w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0])) if n > 1]
    base = filled(usual, BASE_BYTES)
    own = filled(telling_runs(toxic, ordinary), OWN_BYTES) if toxic else b""
    rest = filled(usual[len(base.split()):], len(own))
    return own + base, rest + base, base[-LEAD_BYTES - 100:-100]


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.toxic, model.ordinary):
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=17, chain_log=18, search_log=6, target_length=64,
            write_content_size=False, write_dict_id=False, write_checksum=False)
        if len(content) < 8:
            out.append(zstandard.ZstdCompressor(compression_params=how))
            continue
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=known))
    return out


def saved_bytes(text: bytes, lead: bytes, toxic, ordinary) -> np.ndarray:
    """By how many bytes the toxic dictionary beats the ordinary one, for every window."""
    pieces = [lead + w for w in windows(text)]
    return np.fromiter((len(ordinary.compress(p)) - len(toxic.compress(p)) for p in pieces), np.int64, len(pieces))


def statistics(saved: np.ndarray) -> list[float]:
    """What the calibration sees of a text: best windows, and the windows that save SAVED bytes."""
    if not len(saved):
        return [0.0] * 5
    best = np.sort(saved)[::-1][:3]
    hits = float((saved >= SAVED).sum())
    return [float(best[0]), float(best.mean()), hits / len(saved) ** 0.5, float(np.log1p(len(saved))), hits / len(saved)]


def calibrate(seen: np.ndarray, y: np.ndarray, importance: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised statistics."""
    mean, spread = seen.mean(axis=0), seen.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(seen)), (seen - mean) / spread])
    share, w = importance / importance.sum(), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return mean, spread, w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE) -> Model:
    """Fit on at most `per_class` labelled documents of each class outside fold 0.

    Three fifths of the sample train the dictionaries, whole texts that meet on the driver; the others
    calibrate the scores, of whole texts too. Without documents of both classes the score is
    the share of label 1, or 0 without any label.
    """
    sample, sizes = training_sample(docs.select(key, lowered(text).alias("body")), labels, label, per_class, key)
    if not sizes.get(0) or not sizes.get(1):
        share = float(sizes.get(1, 0) > 0)
        return Model(b"", b"", b"", np.zeros(5), np.ones(5), np.zeros(6), share)
    part = F.pmod(F.xxhash64(key, F.lit("part")), F.lit(5)) < 3

    few = sample.filter(part).select("label", "body").collect()
    toxic = [bytes(r["body"]) for r in few if r["label"] == 1]
    ordinary = [bytes(r["body"]) for r in few if r["label"] == 0]
    own, rest, lead = train_dictionaries(toxic, ordinary)
    model = Model(own, rest, lead, np.zeros(5), np.ones(5), np.zeros(6))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(model)
        for batch in batches:
            rows = [statistics(saved_bytes(b.as_py(), model.lead, *tools)) for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "seen"])

    held = sample.filter(~part).select("label", "body").mapInArrow(measure, "label int, seen array<double>").collect()
    y = np.array([r["label"] for r in held], dtype=float)
    if not len(y) or y.min() == y.max():
        model.constant = sizes[1] / (sizes[0] + sizes[1])
        return model
    weight = class_weights(sizes, Counter(y.astype(int).tolist()), lift=2.5)
    model.mean, model.spread, model.weights = calibrate(np.array([r["seen"] for r in held]), y, np.array([weight[int(v)] for v in y]))
    return model


def lowered(text: str):
    return F.lower(text_of(text)).cast("binary")


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` with the toxicity `score` (0 to 1) of every whole text.

    Null texts are empty; texts without windows get the score of no evidence. Repeated rows score
    alike; an empty table gives no rows. `keep` must not name the result.
    """
    prepared = docs.select(*keep, lowered(text).alias("toxicity_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(model)
        for batch in batches:
            if model.constant is not None:
                scores = [model.constant] * batch.num_rows
            else:
                seen = np.array([statistics(saved_bytes(b.as_py(), model.lead, *tools)) for b in batch.column("toxicity_body")]).reshape(-1, 5)
                z = model.weights[0] + ((seen - model.mean) / model.spread) @ model.weights[1:]
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64())], names=[*keep, name])

    kinds = dict(docs.dtypes)
    return prepared.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{name}` double"]))


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf, "labels"))
    done = score(docs, model, ["doc_id"])
    return done.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
