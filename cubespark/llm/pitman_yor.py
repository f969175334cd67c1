"""Operator 2, language-model scoring with a hierarchical Pitman-Yor model of words given the word before.

Each word is a context with a restaurant of its own; all of them share one parent restaurant over words, whose base is
uniform. The corpus is kept as blocks of texts with packed token numbers. Each block sends its distinct word pairs to
buckets of contexts as packed arrays; a bucket resamples its seatings by Gibbs, its restaurants sharing a parent of the
bucket's own (a random part of all contexts), and sends back what a block's pairs keep of their counts. The tables of all
buckets, sample by sample, then are the customers of the corpus-wide parent, seated in buckets of words. Each sample gives
predictive probabilities, which are averaged. Buckets grow in number with the corpus, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import crc_mod, discard, free_shuffles, mix64, pack, release, runs, saved, table, text_bytes, unpack
from cubespark.llm.seating import discount_of, reseat
from cubespark.llm.wordhash import hash_words

U = np.uint64
#: The hash that stands for the end of a text.
END = U(0x656E64)
STRENGTH = 1.0
PARENT_STRENGTH = 1.0
BLOCK = pa.schema([("pid", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "sizes", "train", "vocab", "counts", "tokens")), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))])
BLOCK_FIELDS = "pid bigint, n_tokens bigint, doc_ids binary, sizes binary, train binary, vocab binary, counts binary, tokens binary, hot array<struct<h:bigint,c:bigint>>"


def make_blocks(docs: DataFrame, block_bytes: int, hot_share: float) -> DataFrame:
    """Blocks of texts: ids, sizes, training marks, distinct words and their training counts, packed token numbers."""

    def block(pid: int, ids: list, train: list, texts: list[bytes]) -> dict:
        h, counts = hash_words(texts)
        where = np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)
        every = np.full(len(h) + len(texts), END, U)
        every[where] = h
        vocab, token = np.unique(every, return_inverse=True)
        mark = np.repeat(np.array(train, bool), counts + 1)
        n = np.bincount(token[mark], minlength=len(vocab))
        hot = np.flatnonzero(n > max(hot_share * len(token), 1))
        return {
            "pid": pid, "n_tokens": len(token), "doc_ids": _ids(ids), "sizes": (counts + 1).astype("<i4").tobytes(), "train": np.array(train, np.uint8).tobytes(),
            "vocab": vocab.tobytes(), "counts": pack(n.astype("<i4")), "tokens": pack_tokens(token, n), "hot": [{"h": int(vocab[i].view(np.int64)), "c": int(n[i])} for i in hot],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0
        for batch in batches:
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                ids.append(i)
                train.append(t)
                texts.append(x or b"")
                size += len(texts[-1])
                if size >= block_bytes or len(ids) >= 200_000:
                    yield pa.RecordBatch.from_pylist([block(part << 24 | k, ids, train, texts)], BLOCK)
                    k, ids, train, texts, size = k + 1, [], [], [], 0
                    release()
        if ids:
            yield pa.RecordBatch.from_pylist([block(part << 24 | k, ids, train, texts)], BLOCK)

    return docs.mapInArrow(run, BLOCK_FIELDS)


def pack_tokens(token: np.ndarray, n: np.ndarray) -> bytes:
    """Token numbers as ranks by count, so that most are small, in planes of bytes."""
    rank = np.empty(len(n), "<i4")
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype="<i4")
    return pack(rank[token].view(np.uint8).reshape(-1, 4).T, 3)


def unpack_tokens(blob: bytes, n: np.ndarray) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(4, -1)
    return np.argsort(-n, kind="stable")[np.ascontiguousarray(planes.T).reshape(-1).view("<i4")]


def _ids(ids: list) -> bytes:
    return np.array([(0 if i is None else i, i is None) for i in ids], "<i8,<i1").tobytes()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(h) >> U(33)) * U(n) >> U(31)).astype(np.int64)


def block_pairs(row: dict, buckets: int, hot: np.ndarray):
    """The block's distinct (context, word) pairs ordered by bucket and context, and each token's pair.

    Pairs of hot contexts are dealt over all buckets by the pair.
    """
    vocab, w = np.frombuffer(row["vocab"], U), unpack_tokens(row["tokens"], unpack(row["counts"], "<i4"))
    end = np.searchsorted(vocab, END)
    u = np.concatenate(([end], w[:-1]))
    code = u * len(vocab) + w
    order = np.argsort(code)
    start = runs(code[order])
    pu, pw = np.divmod(code[order[start]], len(vocab))
    hu, hw = vocab[pu], vocab[pw]
    spread = np.isin(hu, hot)
    bucket = bucket_of(np.where(spread, hu ^ mix64(hw), hu), buckets)
    by = np.argsort(bucket, kind="stable")
    pair = np.empty(len(w), np.int64)
    pair[order] = np.repeat(np.argsort(by), np.diff(np.append(start, len(w))))
    mark = np.repeat(np.frombuffer(row["train"], np.uint8), np.frombuffer(row["sizes"], "<i4"))
    count = np.bincount(pair, weights=mark, minlength=len(by)).astype(np.int64)
    return bucket[by], pu[by], hu[by], hw[by], count, pair, u, w, vocab


PIECE = pa.schema([("bucket", pa.int32()), ("pid", pa.int64()), ("ctx", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def pair_pieces(blocks: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, pu, hu, hw, count, *_ = block_pairs(row, buckets, hot)
                start = runs(bucket)
                rows = []
                for a, b in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True):
                    s = runs(pu[a:b])
                    rows.append({"bucket": int(bucket[a]), "pid": row["pid"], "ctx": hu[a:b][s].tobytes(), "runs": pack(np.diff(np.append(s, b - a)).astype("<i4")), "words": short(hw[a:b]), "counts": pack(count[a:b].astype("<i4"))})
                yield pa.RecordBatch.from_pylist(rows, PIECE)
                del rows, bucket, pu, hu, hw, count, _
                release()

    fields = blocks.select("pid", "sizes", "train", "vocab", "counts", "tokens")
    return fields.mapInArrow(run, "bucket int, pid bigint, ctx binary, runs binary, words binary, counts binary")


def short(h: np.ndarray) -> bytes:
    """The top 40 bits of hashes: enough to tell words apart beside a context's whole hash."""
    return h.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def longer(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(U)


def resample(ctx: np.ndarray, word: np.ndarray, count: np.ndarray, many: np.ndarray, sweeps: int, burn: int, seed: int) -> tuple[float, list[np.ndarray]]:
    """Gibbs sweeps over one bucket's restaurants and their parent.

    ctx, word: numbers of each pair's context and word; many: by how much a context's tables here stand for more elsewhere.
    Returns the discount and each pair's number of tables in each sample, a sample a sweep after the first burn ones.
    """
    rng = np.random.default_rng(seed)
    n_ctx, n_word = int(ctx.max()) + 1, int(word.max()) + 1
    discount = discount_of(count)
    tables = np.minimum(count, 1)
    own = np.bincount(word, weights=tables, minlength=n_word).astype(np.int64)
    above = np.minimum(own, 1)
    samples = []
    for sweep in range(sweeps):
        d0 = discount_of(own)
        mass = (PARENT_STRENGTH + d0 * above.sum()) / max(n_word, 1)
        p = (own - d0 * above + mass) / (PARENT_STRENGTH + own.sum())
        held = np.bincount(ctx, weights=tables, minlength=n_ctx) * many
        step = discount * p[word]
        tables = reseat(count, (STRENGTH + discount * np.maximum(held[ctx] - tables, 0)) * p[word], step, discount, rng)
        own = np.bincount(word, weights=tables, minlength=n_word).astype(np.int64)
        start = (PARENT_STRENGTH + d0 * np.maximum(above.sum() - above, 0)) / max(n_word, 1)
        above = reseat(own, start, np.full(n_word, d0 / max(n_word, 1)), d0, rng)
        if sweep >= burn:
            samples.append(tables.astype(np.int32))
    return discount, samples


MODEL = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("part", pa.int32()), ("discount", pa.float64()), ("hashes", pa.binary()), ("values", pa.binary())])
MODEL_FIELDS = "kind string, key bigint, part int, discount double, hashes binary, values binary"


def seat_buckets(pieces: DataFrame, buckets: int, word_buckets: int, hot: np.ndarray, sweeps: int, burn: int) -> DataFrame:
    """From each bucket: what pairs keep (kind x, for a block), tables by word (w) and by context (c), for word buckets."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["pid"])
        sizes = [unpack(r["runs"], "<i4") for r in rows]
        hu = np.concatenate([np.repeat(np.frombuffer(r["ctx"], U), s) for r, s in zip(rows, sizes, strict=True)])
        hw = np.concatenate([longer(r["words"]) for r in rows])
        n = np.concatenate([unpack(r["counts"], "<i4") for r in rows]).astype(np.int64)
        with np.errstate(over="ignore"):
            key = mix64(hu ^ (mix64(hw) * U(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        start = runs(key[order])
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        first = order[start]
        count = np.add.reduceat(n[order], start)
        seen = np.flatnonzero(count > 0)
        kept = np.zeros(len(start))
        out = []
        if len(seen):
            ctxs, ctx = np.unique(hu[first[seen]], return_inverse=True)
            words, word = np.unique(hw[first[seen]], return_inverse=True)
            many = np.where(np.isin(ctxs, hot), float(buckets), 1.0)
            discount, tables = resample(ctx, word, count[seen], many, sweeps, burn, int(rows[0]["bucket"]) + 1)
            kept[seen] = count[seen] - discount * sum(tables) / len(tables)
            for kind, hashes, value in (("w", words, [np.bincount(word, weights=t) for t in tables]), ("c", ctxs, [np.bincount(ctx, weights=t) for t in tables])):
                bucket, value = word_bucket(hashes, word_buckets), np.stack(value)
                for k in np.unique(bucket).tolist():
                    at = bucket == k
                    out.append({"kind": kind, "key": k, "part": int(rows[0]["bucket"]), "discount": discount, "hashes": short(hashes[at]) if kind == "w" else hashes[at].tobytes(), "values": pack(value[:, at].astype("<i4"))})
            del tables
        at = 0
        for r, s in zip(rows, sizes, strict=True):
            m = int(s.sum())
            out.append({"kind": "x", "key": r["pid"], "part": r["bucket"], "discount": None, "hashes": None, "values": pack(kept[which[at : at + m]].astype("<f4"), 3)})
            at += m
        made = pa.Table.from_pylist(out, MODEL)
        del rows, hu, hw, n, key, order, which, out
        release()
        return made

    return pieces.groupBy("bucket").applyInArrow(run, MODEL_FIELDS)


def word_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """By the top bits alone, so that a whole hash and its short form fall together."""
    return bucket_of(h >> U(24), n)


def word_pieces(blocks: DataFrame, word_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocab, n = np.frombuffer(row["vocab"], U), unpack(row["counts"], "<i4")
                bucket = word_bucket(vocab, word_buckets)
                order = np.argsort(bucket, kind="stable")
                start = runs(bucket[order])
                rows = []
                for a, b in zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
                    at = order[a:b]
                    rows.append({"kind": "v", "key": int(bucket[at[0]]), "part": None, "discount": None, "pid": row["pid"], "hashes": vocab[at].tobytes(), "values": pack(n[at])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([*MODEL, ("pid", pa.int64())])
    return blocks.select("pid", "vocab", "counts").mapInArrow(run, MODEL_FIELDS + ", pid bigint")


WORDS = pa.schema([("pid", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("kept", pa.binary()), ("fresh", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("customers", pa.list_(pa.float64())), ("kept_sum", pa.list_(pa.float64()))])


def seat_words(pieces: DataFrame, word_buckets: int, samples: int) -> DataFrame:
    """Per word bucket: training counts, and in each sample what the corpus-wide parent keeps of each word and each
    context's fresh mass. A sample's tables below are the customers that are seated here."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        blocks = sorted((r for r in rows if r["kind"] == "v"), key=lambda r: r["pid"])
        words, which = np.unique(np.concatenate([np.frombuffer(r["hashes"], U) for r in blocks]), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([unpack(r["values"], "<i4") for r in blocks])).astype(np.int64)
        brief = words >> U(24) << U(24)
        customers, fresh = np.zeros((samples, len(words)), np.int64), np.zeros((samples, len(words)))
        for r in rows:
            if r["kind"] in "wc":
                value = unpack(r["values"], "<i4").reshape(samples, -1)
                at = np.searchsorted(brief, longer(r["hashes"])) if r["kind"] == "w" else np.searchsorted(words, np.frombuffer(r["hashes"], U))
                for k in range(samples):
                    np.add.at(customers[k] if r["kind"] == "w" else fresh[k], at, value[k] if r["kind"] == "w" else r["discount"] * value[k])
        kept = np.zeros((samples, len(words)))
        v = len(words) * word_buckets
        rng = np.random.default_rng(int(blocks[0]["key"]) + 1)
        for k in range(samples if customers.any() else 0):
            d0, above = discount_of(customers[k]), np.minimum(customers[k], 1)
            for _ in range(2):
                start = (PARENT_STRENGTH + d0 * np.maximum(above.sum() * word_buckets - above, 0)) / v
                above = reseat(customers[k], start, np.full(len(words), d0 / v), d0, rng)
            kept[k] = customers[k] - d0 * above
        out, at = [{"pid": -1, "n": int(count.sum()), "v": int((count > 0).sum()), "customers": customers.sum(axis=1).astype(float).tolist(), "kept_sum": kept.sum(axis=1).tolist()}], 0
        for r in blocks:
            i = which[at : at + len(r["hashes"]) // 8]
            at += len(i)
            out.append({"pid": r["pid"], "part": r["key"], "counts": pack(count[i], 3), "kept": pack(kept[:, i].astype("<f4"), 3), "fresh": pack(fresh[:, i].astype("<f4"), 3)})
        made = pa.Table.from_pylist(out, WORDS)
        del rows, blocks, words, which, brief, customers, fresh, kept, out
        release()
        return made

    return pieces.groupBy("key").applyInArrow(run, "pid bigint, part int, counts binary, kept binary, fresh binary, n bigint, v bigint, customers array<double>, kept_sum array<double>")


def hot_contexts(blocks: DataFrame, share: float, total: int) -> np.ndarray:
    """Sorted hashes of the contexts with at least a share of all tokens; at most 1 / share.

    Blocks list what has half the share of their own tokens. What is listed adds up to half the share at least for each
    context wanted; those (at most 2 / share) are then counted in all blocks, so that the outcome doesn't depend on blocks.
    """
    listed = blocks.select(F.explode("hot").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c")).where(F.col("c") >= share / 2 * total).select("h").collect()
    names = np.sort(np.array([r["h"] for r in listed], np.int64).view(U))
    if not len(names):
        return names
    shared = blocks.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vocab, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both, _, at = np.intersect1d(shared.value, np.frombuffer(vocab, U), assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(unpack(counts, "<i4")[at].astype(np.int64))], ["h", "c"])

    counted = blocks.select("vocab", "counts").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= share * total)
    return np.sort(np.array([r["h"] for r in counted.select("h").collect()], np.int64).view(U))


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, sweeps: int = 4, burn: int = 1, bucket_bytes: int = 10 << 20, least_buckets: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every text.

    held_out is a Boolean column of docs; the model learns from all other rows. A null or empty text is its end alone;
    repeated rows count and come back each; null ids are kept; an empty table gives no rows; other columns aren't read.
    Words of more than 64 bytes, like all, are told apart by 64-bit hashes (40 bits beside their context's 64). There is a
    bucket of contexts for each bucket_bytes of text, so scores are the same however the table is laid out. Perplexity of a
    text is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint"), (~held_out).alias("train"), F.col(text_col))
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    if not size[1]:
        return spark.createDataFrame([], SCORES)
    buckets = max(least_buckets, min((size[0] or 0) // bucket_bytes, 1 << 20))
    word_buckets = max(least_buckets, buckets // 2)
    share, samples = 1 / (16 * buckets), sweeps - burn
    blocks = saved(make_blocks(docs, block_bytes, share / 2), "blocks", batch_rows=500)
    hot = hot_contexts(blocks, share, blocks.agg(F.sum("n_tokens")).first()[0])
    model = saved(seat_buckets(pair_pieces(blocks, buckets, hot), buckets, word_buckets, hot, sweeps, burn), "seats")
    free_shuffles(spark)
    pieces = word_pieces(blocks, word_buckets).unionByName(model.where("kind <> 'x'").withColumn("pid", F.lit(None).cast("bigint")))
    words = saved(seat_words(pieces, word_buckets, samples), "words")
    # what pairs keep is all that is still wanted of the seats
    seats, model = model, saved(model.where("kind = 'x'").select("key", "kind", "part", "values"), "kept")
    discard(seats)
    del pieces, seats
    free_shuffles(spark)
    sums = [F.sum(F.col(c)[k]) for c in ("customers", "kept_sum") for k in range(samples)]
    n, v, *both = words.where("pid = -1").agg(F.sum("n"), F.sum("v"), *sums).first()
    customers, kept_sum = np.array(both[:samples])[:, None], np.array(both[samples:])[:, None]

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        row = next(r for r in rows if r["kind"] == "block")
        bucket, _, _, _, _, pair, u, w, vocab = block_pairs(row, buckets, hot)
        kept_pair = np.zeros(len(bucket))
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        by = word_bucket(vocab, word_buckets)
        order = np.argsort(by, kind="stable")
        word_edge = np.searchsorted(by[order], np.arange(word_buckets + 1))
        count, kept, fresh = np.zeros(len(vocab), np.int64), np.zeros((samples, len(vocab))), np.zeros((samples, len(vocab)))
        for r in rows:
            k = r["part"]
            if r["kind"] == "x":
                kept_pair[edge[k] : edge[k + 1]] = unpack(r["values"], "<f4")
            elif r["kind"] == "words":
                at = order[word_edge[k] : word_edge[k + 1]]
                count[at], kept[:, at], fresh[:, at] = unpack(r["counts"], "<i8"), unpack(r["kept"], "<f4").reshape(samples, -1), unpack(r["fresh"], "<f4").reshape(samples, -1)
        p = (kept + (PARENT_STRENGTH + customers - kept_sum) / (v + 1)) / (PARENT_STRENGTH + customers)
        ratio = (STRENGTH + fresh) / (STRENGTH + count)
        # the mean over samples of each sample's predictive probability; what pairs keep is a mean already
        log = kept_pair[pair] / (STRENGTH + count[u])
        for k in range(samples):
            log += ratio[k][u] * p[k][w] / samples
        log = np.log10(log)
        base = np.log10((count + 1) / (n + v + 1))[w]
        del rows, kept_pair, pair, u, order, bucket, kept, fresh, p, ratio
        release()
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        start = np.cumsum(sizes) - sizes
        ids = np.frombuffer(row["doc_ids"], "<i8,<i1")
        return pa.table([
            pa.array([None if x else i for i, x in ids.tolist()], pa.int64()), pa.array(np.frombuffer(row["train"], np.uint8) == 0), pa.array(sizes),
            pa.array(np.add.reduceat((count[w] > 0).astype(np.int64), start)), pa.array(np.full(len(sizes), n, np.int64)),
            pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(log, start)),
        ], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    empty = F.lit(None).cast("binary")
    left = blocks.select("pid", F.lit("block").alias("kind"), F.lit(None).cast("int").alias("part"), empty.alias("values"), "counts", empty.alias("kept"), empty.alias("fresh"), "doc_ids", "sizes", "train", "vocab", "tokens")
    none = [empty.alias(c) for c in ("doc_ids", "sizes", "train", "vocab", "tokens")]
    middle = model.select(F.col("key").alias("pid"), "kind", "part", "values", empty.alias("counts"), empty.alias("kept"), empty.alias("fresh"), *none)
    right = words.where("pid >= 0").select("pid", F.lit("words").alias("kind"), "part", empty.alias("values"), "counts", "kept", "fresh", *none)
    # the last stage reads all three tables, so they stay
    return left.unionByName(middle).unionByName(right).groupBy("pid").applyInArrow(run, SCORES)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, crc_mod(F.col("doc_id"), 7) == 2)
