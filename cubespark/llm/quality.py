"""Operator 3, quality classifier: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, hashed_share, table, text_bytes, unused
from cubespark.llm.rules import SPACES, features

DIM = 4096
#: Common English insults; texts in other languages borrow some. Two in one text are a sign of toxic text.
INSULTS = frozenset(
    b"asshole bastard bitch clown coward creep cretin degenerate dimwit disgusting dumb dumbass fool garbage idiot idiotic idiots imbecile jerk liar loser losers "
    b"lowlife moron moronic morons nitwit pathetic pig retard scum scumbag stupid trash ugly vermin worthless".split()
)
#: 0 says bad, 1 good, -1 abstains. Most know one kind of bad text and abstain on all others.
LABELLERS = {
    "symbols": lambda m: 0 if m["symbols"] > 0.3 else -1,
    "capitals": lambda m: 0 if m["capitals"] > 0.5 else -1,
    "shouting": lambda m: 0 if m["shouts"] > 0.3 else -1,
    "repeats": lambda m: 0 if m["repeats"] > 0.6 and m["n_words"] >= 20 else -1,
    "lines": lambda m: 0 if m["same_lines"] > 0.5 and m["n_words"] >= 20 else -1,
    "digits": lambda m: 0 if m["digits"] > 0.5 else -1,
    "insults": lambda m: 0 if m["insults"] >= 0.2 else -1,
    "variety": lambda m: (0 if m["variety"] < 0.2 and m["n_words"] >= 20 else 1 if m["variety"] > 0.6 else -1),
    "word_length": lambda m: (0 if not 2 <= m["word_length"] <= 12 and m["n_words"] >= 20 else 1 if 3 <= m["word_length"] <= 7 else -1),
}
#: Byte classes: letters are a or A (bytes over 127 count as a), digits 0, white space one blank; other characters stay.
CLASSES = bytes(32 if c in SPACES else 97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in range(256))
#: Letters in lower case; every other byte parts words.
LETTERS = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def measures(text: bytes) -> dict[str, float]:
    n_words, chars, symbols, dup_lines, repeats = features(text)
    n, size = max(n_words, 1), max(chars, 1)
    upper = size_of(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = size_of(text, b"0123456789")
    lines = sum(1 for x in text.split(b"\n") if x.strip())
    words = set(text.lower().split())
    # an insult may stand beside punctuation
    insults = sum(1 for w in text.lower().translate(LETTERS).split() if w in INSULTS) if words else 0
    return {
        "n_words": n_words, "symbols": symbols / n, "capitals": upper / size, "shouts": text.count(b"!") / n, "repeats": repeats / n,
        "variety": len(words) / n ** 0.9, "insults": min(insults, 2) / 10, "same_lines": dup_lines / max(lines, 1), "word_length": chars / n, "digits": digits / size,
    }


def size_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def votes(m: dict[str, float]) -> int:
    """The labellers' votes as one number, three values each."""
    code = 0
    for vote in LABELLERS.values():
        code = code * 3 + vote(m) + 1
    return code


def vote_table(codes: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of each code, a column a labeller."""
    k = len(LABELLERS)
    return np.stack([codes // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)], axis=1)


def vector(text: bytes, m: dict[str, float]) -> np.ndarray:
    """Hashed features: root frequencies of class trigrams, and the measures by tenths."""
    c = np.frombuffer(text.translate(CLASSES), np.uint8).astype(np.uint32)
    if len(c) > 2:
        code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        x = np.sqrt(np.bincount(code, minlength=DIM).astype(np.float32) / len(code))
    else:
        x = np.zeros(DIM, np.float32)
    for name, value in m.items():
        if name != "n_words":
            x[zlib.crc32(f"{name}:{min(int(value * (1 if name == 'word_length' else 10)), 12)}".encode()) % DIM] += 0.3
    return x


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, max_false: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: each pattern's posterior of good, and P(vote | class) of each labeller
    (classes bad and good; votes abstain, bad and good).

    Votes are independent given the class. It starts from the labellers' intent, that a text is bad where one of them says
    so. They are built to be precise, so at most max_false of a labeller's votes on good texts say bad; without that
    bound a labeller that alone knows a common kind of bad text can be outvoted by the others' silence.
    """
    v = vote_table(codes)
    good = np.where((v == 0).any(axis=1), 0.01, 0.95)
    given = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        for y, weight in enumerate((counts * (1 - good), counts * good)):
            for k in range(3):
                given[:, y, k] = (weight @ (v == k - 1)) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        given[:, 1, 1] = np.minimum(given[:, 1, 1], max_false)
        prior = (counts @ good + 1) / (counts.sum() + 2)
        log = np.log([1 - prior, prior]) + sum(np.log(given[j][:, v[:, j] + 1]).T for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, given


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch descent with momentum; each class weighs the same."""
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-3), 0.5 / max((y <= 0.5).mean(), 1e-3)).astype(np.float32)
    weight /= weight.sum()
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y).astype(np.float32) * weight
        vw, vb = 0.9 * vw + x.T @ error + decay * w, 0.9 * vb + error.sum()
        w, b = w - rate * vw, b - 0.1 * rate * vb
    return w, float(b)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> tuple[np.ndarray, float, dict[str, np.ndarray]]:
    """Weights, bias and the labellers' estimates. The accuracies come from all rows; the scorer is fitted on about
    max_rows of them, picked by a hash of the id and text (the documented bound).

    A null or empty text takes part without words; repeated rows weigh each; a null id is hashed with its text; an empty
    table gives weights of zero and no estimates.
    """

    def cast(batch: pa.RecordBatch) -> dict:
        return {"code": [votes(measures(t or b"")) for t in text_bytes(batch.column(0))]}

    patterns = arrow_map(docs.select(text_col), cast, "code bigint").groupBy("code").agg(F.count("*").alias("n")).collect()
    if not patterns:
        return np.zeros(DIM, np.float32), 0.0, {}
    codes, counts = np.array([r["code"] for r in patterns]), np.array([r["n"] for r in patterns], float)
    good, given = estimate(codes, counts)
    share = min(1.0, max_rows / counts.sum())

    def sample(batch: pa.RecordBatch) -> dict:
        out = {"code": [], "at": [], "x": []}
        for t in text_bytes(batch.column(0)):
            m = measures(t or b"")
            x = vector(t or b"", m)
            at = np.flatnonzero(x)
            out["code"].append(votes(m))
            out["at"].append(at.astype("<u2").tobytes())
            out["x"].append(x[at].tobytes())
        return out

    rows = arrow_map(hashed_share(docs, share, id_col, text_col).select(text_col), sample, "code bigint, at binary, x binary").collect()
    if not rows:
        raise RuntimeError("the sample that the scorer is fitted on is empty")
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], np.float32)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    w, b = fit_linear(x, np.array([posterior[r["code"]] for r in rows], np.float32))
    return w, b, dict(zip(LABELLERS, given, strict=True))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> DataFrame:
    """All columns of docs, and as the last one quality_score, the scorer's probability (0 to 1) that the text is good.

    A null or empty text, or one without a word, scores 0. Each row is scored, repeated rows alike. An empty table gives
    no rows. Where columns of docs begin with that name, underscores are added to the score's.
    """
    w, b, _ = fit(docs, id_col, text_col, max_rows)
    names, at, score = docs.columns, docs.columns.index(text_col), unused(docs.columns, "quality_score")

    def run(batch: pa.RecordBatch) -> dict:
        scores = []
        for t in text_bytes(batch.column(at)):
            if not t or not t.strip():
                scores.append(0.0)
                continue
            z = float(vector(t, measures(t)) @ w) + b
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return {n: batch.column(i) for i, n in enumerate(names)} | {score: scores}

    return arrow_map(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double"]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the text goes no further than the scorer
    return score_quality(docs).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))
