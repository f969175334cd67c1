"""Operator 8, benchmark decontamination: an FM-index of each shard is searched for all test phrases."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, saved, table, text_bytes, unused
from cubespark.llm.fmindex import FMIndex

#: Letters A-Z fold, digits, letters and bytes over 127 stay, all other bytes part words.
FOLD = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass
class Phrases:
    """Distinct windows of the benchmark by length, each with the items that hold it: those of window w of a length are
    names[i] for i in held[length][first[length][w] : first[length][w + 1]]."""

    symbol: dict[bytes, int]
    names: list[int | None]
    windows: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    held: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes | None]], width: int) -> Phrases:
        symbol: dict[bytes, int] = {}
        number: dict[int | None, int] = {}
        places: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in rows:
            s = np.array([symbol.setdefault(x, len(symbol) + 1) for x in words_of(text)], np.int32)
            if len(s):
                size = min(width, len(s))
                at = np.lib.stride_tricks.sliding_window_view(s, size)
                places.setdefault(size, []).append(at)
                owners.setdefault(size, []).append(np.full(len(at), number.setdefault(item, len(number)), np.int64))
        windows, first, held = {}, {}, {}
        for size in sorted(places):
            found, which = np.unique(np.concatenate(places[size]), axis=0, return_inverse=True)
            pair = np.unique(which.reshape(-1) * len(number) + np.concatenate(owners[size]))
            windows[size], held[size] = found.astype(np.int64), pair % len(number)
            first[size] = np.searchsorted(pair // len(number), np.arange(len(found) + 1))
        return cls(symbol, list(number), windows, first, held)

    def items(self, size: int, window: int) -> list[int | None]:
        return [self.names[i] for i in self.held[size][self.first[size][window] : self.first[size][window + 1]].tolist()]


def find_hits(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[np.ndarray | None], list[set]]:
    """Per text: words, which of them are hit (None where none is), and the items found.

    The shard's text is indexed over the benchmark's vocabulary: all other words part it, and stretches shorter than the
    shortest phrase can hold none, so they are left out of the index; every occurrence stays.
    """
    words = [words_of(t) for t in texts]
    n = [len(w) for w in words]
    hits: list[np.ndarray | None] = [None] * len(texts)
    items: list[set] = [set() for _ in texts]
    if not phrases.windows or not sum(n):
        return n, hits, items
    get = phrases.symbol.get
    # one 0 after each text parts it from the next
    s = np.fromiter((x for w in words for x in (*map(get, w, (0,) * len(w)), 0)), np.int32, sum(n) + len(n))
    known = s > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    long = end - start >= min(phrases.windows)
    start, size = start[long], (end - start)[long]
    if not len(start):
        return n, hits, items
    begin = np.cumsum(size + 1) - (size + 1)  # in the index, a 0 after each stretch
    source = np.repeat(start - begin, size + 1) + np.arange(int((size + 1).sum()))
    part = s[source].astype(np.int64)
    part[begin + size] = 0
    index = FMIndex(part, len(phrases.symbol) + 1)
    first = np.concatenate(([0], np.cumsum(np.array(n) + 1)))
    change = np.zeros(len(s) + 1, np.int64)
    found_doc, found_window = [], []
    for width, windows in phrases.windows.items():
        low, high = index.search(windows)
        count = high - low
        which = np.repeat(np.arange(len(windows)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        at = source[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        doc = np.searchsorted(first, at, side="right") - 1
        pairs = np.unique(doc * len(windows) + which)
        for d, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist(), strict=True):
            items[d].update(phrases.items(width, w))
    hit = np.cumsum(change[:-1]) > 0
    for d in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
        hits[d] = hit[first[d] : first[d] + n[d]]
    return n, hits, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans [start, end) of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _shards(texts: list, size: int):
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to] or b"") <= size):
            total += len(texts[to] or b"")
            to += 1
        yield at, texts[at:to]
        at = to


def _parts(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[DataFrame]:
    """The benchmark's (item, text) in parts of about most bytes each."""
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = -(-(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // most) or 1
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [rows]


def _merged(hit: np.ndarray | None, spans: list[dict], n: int) -> np.ndarray | None:
    """Hit words of a text, with those of the spans that other parts found."""
    if spans:
        hit = np.zeros(n, bool) if hit is None else hit
        for s in spans:
            hit[s["start"] : s["end"]] = True
    return hit


FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>"


def _search(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, width: int, shard_bytes: int, max_benchmark_bytes: int, finish, schema: str) -> DataFrame:
    """finish(batch, texts, words of each, hits, items) of every batch of docs, with the whole benchmark searched.

    The benchmark's parts are searched in turn: all but the last write the rows with what was found so far beside them, so
    each row stays one row and at most one part of the benchmark is in memory.
    """
    parts, extra = _parts(benchmark, item_col, text_col, max_benchmark_bytes), unused(docs.columns, "found")
    names, at = docs.columns, docs.columns.index(text_col)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for k, part in enumerate(parts):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases.of([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], width))

        def run(batch: pa.RecordBatch, phrases=phrases, first=k == 0, last=k == len(parts) - 1) -> dict:
            texts = text_bytes(batch.column(at))
            n, hits, items = [], [], []
            for _, shard in _shards(texts, shard_bytes):
                for mine, found in zip((n, hits, items), find_hits(shard, phrases.value), strict=True):
                    mine += found
            if not first:
                before = batch.column(len(names)).to_pylist()
                hits = [_merged(h, b["spans"], m) for h, b, m in zip(hits, before, n, strict=True)]
                items = [x | set(b["items"]) for x, b in zip(items, before, strict=True)]
            if last:
                return finish(batch, texts, n, hits, items)
            return {c: batch.column(i) for i, c in enumerate(names)} | {extra: [{"spans": _spans(h), "items": _sorted(x)} for h, x in zip(hits, items, strict=True)]}

        if k < len(parts) - 1:
            docs = saved(arrow_map(docs, run, f"{own}, `{extra}` struct<spans:array<struct<start:bigint,end:bigint>>,items:array<bigint>>"), "found")
    return arrow_map(docs, run, schema)


def _spans(hit: np.ndarray | None) -> list[dict]:
    return [] if hit is None else [{"start": a, "end": b} for a, b in spans_of(hit)]


def _sorted(items: set) -> list:
    return sorted(items, key=lambda i: (i is None, i))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 10, shard_bytes: int = 8 << 20, max_benchmark_bytes: int = 8 << 20) -> DataFrame:
    """id, n_words, spans (merged removal spans in words), items (sorted) of every text.

    Phrases go to all executors; a benchmark of more than max_benchmark_bytes is taken in so many parts that each stays
    under it, one after the other. A null text has no words; a null item id is an item of its own; each row, repeated or
    with a null id, gives one row; an empty benchmark hits nothing; an empty table gives no rows; other columns aren't read.
    """

    def finish(batch: pa.RecordBatch, texts: list, n: list, hits: list, items: list) -> dict:
        return {id_col: batch.column(0), "n_words": n, "spans": [_spans(h) for h in hits], "items": [_sorted(x) for x in items]}

    return _search(docs.select(id_col, text_col), benchmark, text_col, item_col, width, shard_bytes, max_benchmark_bytes, finish, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {FOUND}")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", width: int = 10, shard_bytes: int = 8 << 20, max_benchmark_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs without the hit words (from a span's first word to its last); clean texts stay as they are.

    Columns and their order stay, whatever their names. A benchmark of any size is taken as find_contamination takes it.
    Null texts stay null; repeated rows are treated alike; an empty table or benchmark changes nothing.
    """
    names = docs.columns

    def finish(batch: pa.RecordBatch, texts: list, n: list, hits: list, items: list) -> dict:
        out = list(texts)
        for i, h in enumerate(hits):
            if h is not None:
                t, kept, done = texts[i], [], 0
                places = [m.span() for m in WORD.finditer(t)]
                for a, b in spans_of(h):
                    kept.append(t[done : places[a][0]])
                    done = places[b - 1][1]
                out[i] = b"".join([*kept, t[done:]])
        return {c: out if c == text_col else batch.column(i) for i, c in enumerate(names)}

    return _search(docs, benchmark, text_col, item_col, width, shard_bytes, max_benchmark_bytes, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

    def run(batch: pa.RecordBatch) -> dict:
        items = batch.column(3).to_pylist()
        hit = [sum(s["end"] - s["start"] for s in x) for x in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0), "n_words": batch.column(1), "n_hit": hit, "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted("" if i is None else str(i) for i in x)).encode()).hexdigest() for x in items], "contaminated": [h > 0 for h in hit],
        }

    return arrow_map(found, run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
