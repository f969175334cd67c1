"""Operator 4, packing: shortest-pack-first over the length histogram, patterns joined back to pieces by rank."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, saved, table

#: Texts of code points below this take the vectorised path if their lower case stays below the other, others the tokenizer's own.
LATIN, LOWERED = 0x250, 0x370
#: Texts are tokenized in blocks of at most so many code points (a longer text is a block of its own).
BLOCK_CHARS = 1 << 19
#: Longer pre-tokens are encoded by themselves.
LONG = 64
#: Counts that one length's ranks are added up from.
MAX_BUCKETS = 1 << 14
LETTER, NUMBER, SPACE, OTHER = 1, 2, 0, 3
#: What may follow an apostrophe in a pre-token of its own.
CLITICS = ("s", "t", "m", "d", "re", "ve", "ll")


class WordTokenizer:
    """Ids of a word-level byte-pair tokenizer, each distinct pre-token encoded once a block.

    The tokenizer merges inside pre-tokens only, so a text's ids are its pre-tokens' ids in turn. Pre-tokens are found and
    hashed for a block of texts at once; ids of those seen lately are kept in flat arrays. Texts with other scripts (before
    or after lower-casing) or with the strings of special tokens are encoded whole. The library runs in one thread.
    """

    def __init__(self, path: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each thread of the library would hold memory of its own
        from tokenizers import Tokenizer

        self.memo = memo
        self._tok = Tokenizer.from_file(path)
        kind = {"L": LETTER, "N": NUMBER}
        self._class = np.array([SPACE if 9 <= c <= 13 or c in (0x20, 0x85, 0xA0) else kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LOWERED)], np.uint8)
        self._plain = re.compile(f"[\\x00-\\u{LATIN - 1:04x}]*").fullmatch
        self._low = re.compile(f"[\\x00-\\u{LOWERED - 1:04x}]*").fullmatch
        self._code = np.random.default_rng(7).integers(0, 1 << 63, (LONG, LOWERED), np.int64).astype(np.uint64)
        vocabulary = self._tok.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _keep(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Known pre-tokens, by hash: how many ids each has, where they begin, and the ids."""
        self._hash, self._size, self._from, self._ids = hashes, sizes, np.cumsum(sizes) - sizes, ids

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens in the order taken (by number), how many ids each has, and the ids.

        Those of letters are encoded many at once: each word's last token has the end mark.
        """
        words = [i for i, w in enumerate(new) if w.isalpha()]
        rest = [i for i, w in enumerate(new) if not w.isalpha()]
        groups = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        taken, sizes, ids = [], [], []
        for part, e in zip(groups, self._tok.encode_batch_fast([" ".join([new[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self._ends[got]) + 1
            if len(ends) == len(part):
                taken += part
                sizes.append(np.diff(ends, prepend=0))
                ids.append(got)
            else:
                rest += part
        singles = [e.ids for e in self._tok.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, singles), np.int64, len(singles)))
        ids.append(np.array([x for one in singles for x in one], "<u4"))
        return np.array(taken + rest, np.int64), np.concatenate(sizes), np.concatenate(ids)

    def _starts(self, c: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end places of the pre-tokens in code points between white space."""
        first = (kind != SPACE) & (np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == NUMBER))
        quote = np.flatnonzero((c == 39) & first)
        if len(quote):
            padded = np.concatenate((c[: int(quote[-1]) + 3], [0, 0, 0]))
            size = np.zeros(len(quote), np.int64)
            for x in CLITICS:
                size = np.maximum(size, np.where(np.all([padded[quote + 1 + i] == ord(y) for i, y in enumerate(x)], axis=0), len(x), 0))
            quote, size = quote[size > 0], size[size > 0]
            first[quote + 1] = False
            after = quote + 1 + size
            after = after[after < len(c)]
            first[after] |= kind[after] != SPACE
        start = np.flatnonzero(first)
        # a pre-token ends where the next begins, or white space does
        gap = np.append(np.flatnonzero(kind == SPACE), len(c))
        return start, np.minimum(np.append(start[1:], len(c)), gap[np.searchsorted(gap, start)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        lowered, whole = [], {}
        for i, text in enumerate(texts):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            low = text.lower()
            if "<|" in text or not (text.isascii() or self._plain(text) and self._low(low)):
                whole[i] = np.array(self._tok.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
                low = ""
            lowered.append(low)
        joined = "\n".join(lowered) + "\n"
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        start, end = self._starts(c, self._class[c])
        size = end - start
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        source = place + np.repeat(start, size)
        hashes = np.add.reduceat(self._code[place & (LONG - 1), c[source]], np.cumsum(size) - size) if len(start) else np.zeros(0, np.uint64)
        far = np.flatnonzero(size > LONG)
        for k in far.tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(joined[start[k] : end[k]].encode("utf-32-le", "surrogatepass"))
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self._hash, unique), max(len(self._hash) - 1, 0))
        known = self._hash[spot] == unique if len(self._hash) else np.zeros(len(unique), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            taken, sizes, ids = self._encode([joined[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            if len(self._hash) + len(new) > self.memo:  # start anew with what this block uses
                old = spot[known]
                keep = np.repeat(self._from[old] - (np.cumsum(self._size[old]) - self._size[old]), self._size[old]) + np.arange(int(self._size[old].sum()))
                self._keep(self._hash[old], self._size[old], self._ids[keep])
            merged = np.concatenate((self._hash, unique[new[taken]]))
            order = np.argsort(merged)
            all_sizes, all_ids = np.concatenate((self._size, sizes)), np.concatenate((self._ids, ids))
            begins = np.concatenate((self._from, len(self._ids) + np.cumsum(sizes) - sizes))
            s = all_sizes[order]
            self._keep(merged[order], s, all_ids[np.repeat(begins[order] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))])
            spot = np.searchsorted(self._hash, unique)
        token = spot[inverse]
        n = self._size[token]
        stop = np.cumsum(n)
        ids = self._ids[np.repeat(self._from[token] - (stop - n), n) + np.arange(int(n.sum()))].tobytes()
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        cuts = np.concatenate(([0], stop))[np.searchsorted(start, begins)] * 4
        return [whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


@lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer: loaded once, whatever the number of its tasks."""
    return WordTokenizer(path)


def _blocks(texts: list[str], rows: int = 256):
    """First numbers and runs of texts of at most rows texts and BLOCK_CHARS code points."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to < at + rows and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts: lengths placed longest first, each in the shortest open pack that takes it.

    Works on counts: its time depends on the number of distinct lengths (at most capacity), not on that of pieces; the
    packs' sizes are those of placing the pieces one by one.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    shortest = capacity + 1

    def add(count: int, pattern: tuple[int, ...]) -> None:
        nonlocal shortest
        size = sum(pattern)
        open_packs[size].append((count, pattern))
        shortest = min(shortest, size)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            while shortest <= capacity and not open_packs.get(shortest):
                shortest += 1
            if shortest + length > capacity:  # new packs: each is the shortest until it is full
                fit = capacity // length
                if left >= fit:
                    add(left // fit, (length,) * fit)
                if left % fit:
                    add(1, (length,) * (left % fit))
                left = 0
            else:
                count, pattern = open_packs[shortest].pop()
                used = min(left, count)
                if count > used:
                    open_packs[shortest].append((count - used, pattern))
                add(used, (*pattern, length))
                left -= used
    return [x for size in sorted(open_packs) for x in open_packs[size]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs of slots ordered by (length, first rank): which sequences and offset the pieces of those ranks get."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], base, offset))
            rank[length] += count
            offset += length
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids of every document, whose ids end in end_id.

    A null or empty text is its end id alone; a null id is kept; repeated rows are cut each; an empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("at", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        tokenizer = tokenizer_of(tokenizer_path)
        for at, texts in _blocks([t or "" for t in batch.column(1).to_pylist()]):
            for i, ids in enumerate(tokenizer(texts), at):
                ids += end
                for s in range(0, len(ids), 4 * capacity):
                    piece = ids[s : s + 4 * capacity]
                    out["at"].append(i)
                    out["start"].append(s // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
                    out["ids"].append(piece if keep_ids else None)
        out["doc_id"] = batch.column(0).take(pa.array(out.pop("at"), pa.int64()))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_col), run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int, rows_a_bucket: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset. pieces must be a written table: ranks are taken from it twice.

    Ranks within a length come from counts of (length, bucket) plus a rank inside the bucket, so that a length shared by
    a third of all pieces is dealt over many tasks. Only the histogram, at most capacity rows, goes to the driver; a
    length has at most MAX_BUCKETS counts, whatever the number of pieces. A null id ranks first; an empty table gives none.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = min(max(1, -(-sum(histogram.values()) // rows_a_bucket)) * 8, MAX_BUCKETS)
    plan = spark.sparkContext.broadcast(slots(plan_packs(histogram, capacity)))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in")
    names = [n for n in ranked.columns if n != "_rank"]

    def run(batch: pa.RecordBatch) -> dict:
        p = plan.value
        length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
        shift = np.int64(1) << np.int64(48)
        i = np.searchsorted(p["length"] * shift + p["rank"], length * shift + rank, side="right") - 1
        return {n: batch.column(n) for n in names} | {"sequence_id": p["sequence"][i] + rank - p["rank"][i], "offset": p["offset"][i]}

    return arrow_map(ranked, run, ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != "_rank") + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into sequences of at most capacity ids.

    A null or empty text is its end id alone. Repeated rows are packed each. An empty table gives no pieces. Ties in
    length are ranked by id, start and checksum. Other columns aren't read. ids holds each piece's ids if keep_ids.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = cut_pieces(docs, str(tokenizer_path), capacity, end_id, id_col, text_col, keep_ids)
    return pack_pieces(saved(pieces if keep_ids else pieces.drop("ids"), "pieces", batch_rows=2000), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
