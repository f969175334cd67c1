"""Operator 6, language identification: script ranges, word scores, and Viterbi spans with a switching penalty."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, crc_mod, hashed_share, table, text_bytes

#: First code points of script blocks, from the Unicode standard.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
)
NAMES = ("", *dict.fromkeys(n for _, n in SCRIPTS))
BITS = 16
DISALLOWED = -60.0


@lru_cache(1)
def script_table() -> tuple[np.ndarray, np.ndarray]:
    """Script number of each code point, 0 for what is neither letter nor mark; and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.fromiter((k == "L" for k in kinds), bool, len(kinds))
    mark = np.fromiter((k == "M" for k in kinds), bool, len(kinds))
    starts = np.array([s for s, _ in SCRIPTS])
    numbers = np.array([0, *(NAMES.index(n) for _, n in SCRIPTS)], np.uint8)
    script = numbers[np.searchsorted(starts, np.arange(len(kinds)), side="right")]
    script[0x10000:] = NAMES.index("other")
    script[0x20000:0x33480] = NAMES.index("han")
    return np.where(letter | mark, script, 0).astype(np.uint8), letter


def letters_of(texts: list[str]):
    """Letters of the joined, lower-cased texts: place, text number, trigram code, script, and starts of words among them.

    Words are runs of letters and their marks; marks without a letter are none. Lower-casing is per character where it
    keeps the length, so places stay those of the texts.
    """
    lowered = [low if len(low := t.lower()) == len(t) else "".join(c.lower()[:1] for c in t) for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    scripts, letter = script_table()
    script = scripts[c]
    at = np.flatnonzero(script)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    if len(at) and not (has := np.logical_or.reduceat(letter[c[at]], starts)).all():
        size = np.diff(np.append(starts, len(at)))
        at, size = at[np.repeat(has, size)], size[has]
        starts = np.cumsum(size) - size
    folded = np.where(script > 0, c, 32)
    a, b, d = folded[at - 1], folded[at], folded[at + 1]
    code = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) * np.uint32(5) ^ d * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(begins, at[starts], side="right") - 1 if len(at) else np.zeros(0, np.int64)
    return at, code, script[at], starts, doc, begins


class LanguageModel:
    """Log-probabilities of hashed letter trigrams in each language, and the scripts each is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, alpha: float = 0.05):
        self.langs = langs
        p = (counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1])
        self.log = np.log(p).T.astype(np.float32).copy()
        used = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        used[:, ~used.any(axis=0)] = True
        self.barred = np.where(used, 0.0, DISALLOWED).T.copy()

    def words(self, texts: list[str]):
        """Per word: text number, first and end place, letters, and a row of scores."""
        at, code, script, starts, doc, begins = letters_of(texts)
        if not len(at):
            return doc, doc, doc, doc, np.zeros((0, len(self.langs)))
        score = np.add.reduceat(self.log[code], starts, axis=0, dtype=np.float64) + self.barred[script[starts]]
        size = np.diff(np.append(starts, len(at)))
        first = at[starts] - begins[doc]
        return doc, first, first + size, size, score


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of one text's words when each change of language costs penalty."""
    n, k = score.shape
    back = np.empty((n, k), np.int16)
    best = score[0].copy()
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[t] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - penalty) + score[t]
    labels = np.empty(n, np.int64)
    labels[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def label_words(doc: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of all texts' words. A text needs the search only if some language gains more than half the penalty
    over the text's best language in a run of words: a path of m changes has at most m + 1 runs that gain, and m + 1 <= 2 m.
    Else no change of language can pay, and one label is the optimum."""
    n = len(doc)
    if not n:
        return doc
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    number = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    total = np.add.reduceat(score, starts, axis=0)
    best = total.argmax(axis=1)
    labels = best[number]
    own = score[np.arange(n), labels]
    gain = np.zeros(len(starts))
    for k in range(score.shape[1]):
        d = score[:, k] - own
        run = np.cumsum(d)
        run -= (run[starts] - d[starts])[number]  # sums from each text's first word on
        low = np.minimum(0, run - d)
        # a lower floor for each text makes the running minimum start anew there
        step = 1.0 - low.min()
        floor = np.minimum.accumulate(low - number * step) + number * step
        gain = np.maximum(gain, np.maximum.reduceat(run - floor, starts))
    ends = np.append(starts[1:], n)
    for i in np.flatnonzero(gain > penalty / 2 - 1e-6).tolist():
        labels[starts[i] : ends[i]] = viterbi(score[starts[i] : ends[i]], penalty)
    return labels


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000) -> LanguageModel:
    """Trigram and script counts of each language, from about max_rows labelled rows picked by a hash of the id and text
    (the documented bound); the counts that reach the driver are at most 2^16 a language.

    Rows with a null text or label are left out; repeated rows count each; an empty table gives a model of no languages.
    """
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    n = docs.count()
    docs = hashed_share(docs, min(1.0, max_rows / max(n, 1)), "id", "text").select("lang", "text")

    def run(batch: pa.RecordBatch) -> dict:
        out = {"lang": [], "code": [], "n": []}
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            _, code, script, _, _, _ = letters_of(texts[langs == lang].tolist())
            n = np.bincount(np.concatenate((code.astype(np.int64), (1 << BITS) + script.astype(np.int64))))
            at = np.flatnonzero(n)
            out["lang"] += [lang] * len(at)
            out["code"].append(at)
            out["n"].append(n[at])
        return {"lang": out["lang"], "code": np.concatenate(out["code"]), "n": np.concatenate(out["n"])}

    rows = arrow_map(docs, run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("code").alias("code"), F.collect_list("n").alias("n")).toPandas()
    if n and not len(rows):
        raise RuntimeError("the sample of labelled texts is empty or holds no letter")
    langs = sorted(rows["lang"])
    counts = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
    for lang, code, n in zip(rows["lang"], rows["code"], rows["n"], strict=True):
        counts[langs.index(lang), np.asarray(code)] = np.asarray(n)
    return LanguageModel(langs, counts[:, : 1 << BITS], counts[:, 1 << BITS :])


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 16.0, block_chars: int = 1 << 20) -> DataFrame:
    """id, lang_pred (most letters; ties go to the first by name), score (its share of letters), spans of languages.

    Spans are (start, end, lang) in code points of the first and last letters. A text that is null or has no letter, or
    a model without languages, gives und, 0 and no spans. Repeated rows count each; other columns aren't read.
    """

    def block(texts: list[str]) -> list[tuple]:
        doc, first, end, size, score = model.words(texts)
        out = [("und", 0.0, [])] * len(texts)
        if not len(doc) or not model.langs:
            return out
        labels, k = label_words(doc, score, penalty), len(model.langs)
        share = np.bincount(doc * k + labels, weights=size, minlength=len(texts) * k).reshape(-1, k)
        total, top = share.sum(axis=1), share.argmax(axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1]))))
        stops = np.append(starts[1:], len(doc)) - 1
        spans: list[list] = [[] for _ in texts]
        for d, s, e, x in zip(doc[starts].tolist(), first[starts].tolist(), end[stops].tolist(), labels[starts].tolist(), strict=True):
            spans[d].append({"start": s, "end": e, "lang": model.langs[x]})
        return [(model.langs[top[i]], float(share[i, top[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, []) for i in range(len(texts))]

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= block_chars):
                size += len(texts[to])
                to += 1
            out += block(texts[at:to])
            at = to
        return {id_col: batch.column(0), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "spans": [x[2] for x in out]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = fit_languages(docs.where(~held_out))
    return label_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
