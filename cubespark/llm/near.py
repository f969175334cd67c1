"""Operator 7, n-gram Jaccard join by parity sketches.

Each shingle toggles one bit of a document's sketch (XOR), so the Hamming distance of two sketches is at most the size of
the sets' symmetric difference D. Jaccard t means D <= (1 - t) / (1 + t) * (|A| + |B|). In a size band the sketch has so
many segments that more of them hold a bit than can differ; by the pigeonhole principle a linked pair then agrees in one of
the first D + 1 non-empty segments of either in any common order. Fuller segments come first: they are the most telling.
A set with no more than D non-empty segments adds its first D + 1 shingles in a common order as keys of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, discard, mix64, pack, release, runs, saved, table, text_bytes, unpack, unused
from cubespark.llm.components import components

U = np.uint64
#: Odd multipliers of the words in a shingle.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
SALTS = 16
#: Rows that go to a worker at a time.
ROWS = 5000


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of width words; a shorter text is one shingle."""
    known: dict[bytes, int] = {}
    word = xxhash.xxh3_64_intdigest
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words])
    every = set().union(*words)
    known = {w: word(w) for w in every}
    h = np.fromiter((x for w in words for x in map(known.__getitem__, w)), U, int(n.sum()))
    with np.errstate(over="ignore"):
        parts = [h * ODD[k] for k in range(width)]
        size = len(h) - width + 1
        full = mix64(sum((parts[k][k : k + size] for k in range(1, width)), parts[0][:size].copy())) if size > 0 else h[:0]
        out, at = [], 0
        for m in n.tolist():
            if m >= width:
                out.append(np.unique(full[at : at + m - width + 1]))
            elif m:
                out.append(mix64(np.array([U(m) + sum((parts[k][at + k] for k in range(m)), U(0))], U) ^ U(0x5851F42D4C957F2D)))
            else:
                out.append(h[:0])
            at += m
    return out


def short_sketch(s: np.ndarray) -> bytes:
    """The sketch folded to a power of two of at least twice as many bits as the set has members (64 at least)."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of bytes folded to fewer: its parts XORed, which keeps the bound on distances."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def sketch_distance(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def keys(s: np.ndarray, top: int = 75) -> np.ndarray:
    """Join keys of a set: the first segments of its sketch in each size band where a partner can be.

    A band holds sizes from 2^j to 2^(j+1); sets a little over its end, that can be linked with some in it, join it too.
    """
    n, out = len(s), []
    if not n:
        return s
    j = n.bit_length() - 1
    bands = [(j, min(n * 100 // top, ((2 << j) - 1) * 100 // top))]
    if n * top <= ((1 << j) - 1) * 100:
        bands.append((j - 1, (1 << j) - 1))
    for band, partner in bands:
        differ = (100 - top) * (n + partner) // (100 + top)
        bits = band + 2 if band < 8 else band
        seg = s >> U(64 - bits) if bits else np.zeros(n, U)
        start = runs(seg)
        code = mix64(np.bitwise_xor.reduceat(mix64(s ^ U(0x2545F4914F6CDD1D)), start) ^ mix64(seg[start] + U(band << 40)))
        size = np.diff(np.append(start, n))
        order = (U(255) - np.minimum(size, 255).astype(U)) << U(56) | code >> U(8)
        if len(code) <= differ:  # all may differ: the first shingles of a common order can't, and a partner that shares no segment emits them too
            first = mix64(s ^ U(0x9FB21C651E98DF25))
            first = np.partition(first, differ)[: differ + 1] if n > differ + 1 else first
            code = np.concatenate((code, mix64(first ^ U((band << 40) + 1))))
        elif len(code) > differ + 1:
            code = code[np.argpartition(order, differ)[: differ + 1]]
        out.append(code)
    return np.concatenate(out)


def sketch_pass(docs: DataFrame, id_col: str, text_col: str, buckets: int, top: int, width: int) -> DataFrame:
    """One row a document (id, n, sig, short sketch), and packed join keys of distinct sets by bucket of the key."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        out = {k: [] for k in ("bucket", "doc_id", "n", "sig", "sketch", "keys", "owners")}
        best: dict[bytes, tuple[int, int]] = {}
        codes, owners = [], []
        texts, at = text_bytes(batch.column(1)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or b"") <= 4 << 20):
                size += len(texts[to] or b"")
                to += 1
            for i, s in enumerate(shingle_sets(texts[at:to], width), at):
                sig = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                out["doc_id"].append(ids[i])
                out["n"].append(len(s))
                out["sig"].append(sig)
                out["sketch"].append(short_sketch(s) if len(s) else None)
                if sig is None or ids[i] is None:
                    continue
                if sig not in best:
                    codes.append(keys(s, top))
                    owners.append(len(codes) - 1)
                    best[sig] = (ids[i], len(codes) - 1)
                elif ids[i] < best[sig][0]:
                    best[sig] = (ids[i], best[sig][1])
            at = to
        rows = len(out["doc_id"])
        out["bucket"] += [None] * rows
        out["keys"] += [None] * rows
        out["owners"] += [None] * rows
        if codes:
            owner = np.empty(len(codes), np.int64)
            for doc, k in best.values():
                owner[k] = doc
            code = np.concatenate(codes)
            own = np.repeat(owner, [len(c) for c in codes])
            bucket = (code >> U(33)) * U(buckets) >> U(31)
            order = np.argsort(code)
            code, own, bucket = code[order], own[order], bucket[order]
            start = runs(bucket)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(code)], strict=True):
                out["bucket"].append(int(bucket[a]))
                out["keys"].append(code[a:b].tobytes())
                out["owners"].append(pack(own[a:b]))
            more = len(start)
            for k in ("doc_id", "n", "sig", "sketch"):
                out[k] += [None] * more
        return out

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), text_col), run, "bucket int, doc_id bigint, n bigint, sig binary, sketch binary, keys binary, owners binary", slice_bytes=None)


def key_groups(packed: DataFrame) -> DataFrame:
    """(key, doc_id) of keys that two or more documents hold."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        code = np.concatenate([np.frombuffer(b, U) for b in t.column("keys").to_pylist()])
        own = np.concatenate([unpack(b, "<i8") for b in t.column("owners").to_pylist()])
        order = np.argsort(code)
        code = code[order]
        same = code[1:] == code[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        made = pa.table([code[keep].view(np.int64), own[order][keep]], schema=schema)
        del code, own, order, same, keep
        release()
        return made

    return packed.groupBy("bucket").applyInArrow(run, "key bigint, doc_id bigint")


def linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, top: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least top %, counted exactly from the texts."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    bits = _id_filter(ids)
    if bits is None:
        return pairs.limit(0).select("a", "b")
    shared = spark.sparkContext.broadcast(bits)

    def sets(batch: pa.RecordBatch) -> dict | None:
        ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
        at = mix64(ids.view(U)) & U(8 * len(shared.value) - 1)
        keep = np.flatnonzero(np.frombuffer(shared.value, np.uint8)[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1)
        if not len(keep):
            return None
        texts = text_bytes(batch.column(1).take(pa.array(keep)))
        return {"id": ids[keep], "set": [s.tobytes() for s in shingle_sets(texts, width)]}

    held = arrow_map(docs.select(F.col(id_col).cast("bigint"), text_col), sets, "id bigint, set binary")
    held = saved(held.join(ids, "id", "left_semi"), "sets", ROWS)
    joined = pairs.select("a", "b").join(held.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def verify(batch: pa.RecordBatch) -> dict:
        ok = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            s, t = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= top * (len(s) + len(t) - both))
        ok = np.array(ok, bool)
        return {"a": batch.column("a").filter(pa.array(ok)), "b": batch.column("b").filter(pa.array(ok))}

    links = saved(arrow_map(joined.select("a", "b", "sa", "sb"), verify, "a bigint, b bigint"), "links")
    discard(held)
    return links


def _id_filter(ids: DataFrame, max_bits: int = 27) -> bytes | None:
    """A bitmap of hashed ids, of at most 2^max_bits bits whatever the number of ids; None if there are none."""
    n = ids.count()
    if not n:
        return None
    log = min(max_bits, max(13, (8 * n).bit_length()))

    def place(batch: pa.RecordBatch) -> dict:
        return {"at": (mix64(np.asarray(batch.column(0)).view(U)) & U((1 << log) - 1)).astype(np.int64)}

    schema = pa.schema([("part", pa.int64()), ("bits", pa.binary())])

    def gather(t: pa.Table) -> pa.Table:
        at = np.asarray(t.column("at"))
        bits = np.zeros(1 << 16, np.uint8)
        bits[at & 0xFFFF] = 1
        return pa.table([pa.array([int(at[0]) >> 16]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], schema=schema)

    out = bytearray((1 << log) // 8 if log >= 16 else 1 << 13)
    rows = arrow_map(ids, place, "at bigint").groupBy(F.shiftright("at", 16)).applyInArrow(gather, "part bigint, bits binary").collect()
    for r in rows:
        out[r["part"] << 13 : (r["part"] + 1) << 13] = r["bits"]
    return bytes(out[: max((1 << log) // 8, 1)])


#: Key groups of up to so many members are taken together.
SMALL = 12
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_pairs(groups: pa.Table, sketches: pa.Table, top: int, forest: int | None) -> pa.Table:
    """Pairs of a bucket's key groups that lie in two components and whose sizes and sketches allow a link.

    In a forest, a pair counts as linked as soon as it is put out, so that a group of many gives about one pair a member;
    members are taken in the order of a hash of their ids. In forest 0 all key groups agree on the hubs; in forest 1 each
    bucket has its own, so that what the first hub was no match for meets as many others as there are buckets. Pairs of
    small groups are compared once for all keys that they share.
    """
    ids = np.asarray(sketches.column("id"))
    n = np.asarray(sketches.column("size"))
    with np.errstate(over="ignore"):
        salt = np.int64(groups.column("bucket")[0].as_py()).astype(U) + U(1) if forest else U(0)
        hashed = np.argsort(mix64(ids.view(U) + salt), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[hashed] = np.arange(len(ids))
    by_id = np.argsort(ids)
    member = place[by_id[np.searchsorted(ids[by_id], np.asarray(groups.column("rep")))]]
    ids, n = ids[hashed], n[hashed]
    raw = sketches.column("bits").to_pylist()
    bits = [np.frombuffer(raw[i], np.uint8) for i in hashed.tolist()]
    root = np.empty(len(ids), np.int64)
    root[member] = np.unique(np.asarray(groups.column("root")), return_inverse=True)[1]
    up = np.arange(int(root.max()) + 1)  # components joined so far in this bucket

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    key = np.asarray(groups.column("key"))
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    start, found = runs(key), []
    sizes = np.diff(np.append(start, len(key)))
    for a, b in zip(start[sizes > SMALL].tolist(), (start + sizes)[sizes > SMALL].tolist(), strict=True):
        who = member[a:b]
        own = root[who] if forest is None else np.array([find(x) for x in root[who].tolist()])
        if (own == own[0]).all():
            continue
        size = min(len(bits[i]) for i in who.tolist())
        words = np.stack([folded(bits[i], size) for i in who.tolist()]).view(U)
        m = n[who]
        for i in range(len(who) - 1):
            other = np.flatnonzero((own[i + 1 :] != own[i]) & (100 * np.minimum(m[i + 1 :], m[i]) >= top * np.maximum(m[i + 1 :], m[i]))) + i + 1
            for at in range(0, len(other), 4096):
                some = other[at : at + 4096]
                far = np.bitwise_count(words[some] ^ words[i]).sum(axis=1, dtype=np.int64)
                for o in some[far * (100 + top) <= (100 - top) * (m[some] + m[i])].tolist():
                    if forest is not None:
                        if own[o] == own[i]:
                            continue
                        up[own[o]] = own[i]
                        own[own == own[o]] = own[i]
                    found.append((int(who[i]), int(who[o])))
    codes = [np.zeros(0, np.int64)]
    for size in range(2, SMALL + 1):
        who = member[start[sizes == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        codes.append(np.unique(who[:, i] * len(ids) + who[:, j]))
    x, y = np.divmod(np.unique(np.concatenate(codes)), len(ids))
    ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= top * np.maximum(n[x], n[y]))
    for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        if forest is not None:
            u, v = find(int(root[i])), find(int(root[j]))
            if u == v:
                continue
        size = min(len(bits[i]), len(bits[j]))
        if int(np.bitwise_count(folded(bits[i], size) ^ folded(bits[j], size)).sum()) * (100 + top) <= (100 - top) * int(n[i] + n[j]):
            if forest is not None:
                up[v] = u
            found.append((i, j))
    del key, member, order, codes, raw, bits
    release()
    at = np.array(found, np.int64).reshape(-1, 2)
    pairs = np.unique(np.sort(ids[at], axis=1), axis=0).reshape(-1, 2)
    return pa.table([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=PAIRS)


#: Key groups of more members than that are dealt out in blocks of about as many.
BLOCK = 4096


def open_pairs(groups: DataFrame, reps: DataFrame, roots: DataFrame | None, buckets: int, top: int, forest: int | None, block: int, tried: DataFrame | None) -> DataFrame:
    """Distinct pairs of _bucket_pairs over all buckets of keys, but for those tried, as a written table.

    Only keys that reach into two components are looked at.

    A group of more than block members is parted by a hash of them. In a forest each part is a bucket of its own, parted
    differently in each forest, so that the second joins what the first has apart; in the last round each two parts are a
    bucket, so that all pairs meet and no task holds more than two parts.
    """
    rooted = groups.withColumn("root", F.col("rep"))
    if roots is not None:
        rooted = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = saved(rooted.select("key", "rep", "root"), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", F.ceil(F.col("c") / block).cast("int").alias("parts"))
    placed = rooted.join(mixed, "key")
    part = F.pmod(F.xxhash64("rep", F.lit(forest or 0)), F.col("parts")).cast("int")
    if forest is not None:
        split = F.xxhash64("key", part)
    else:
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != part)
        split = F.explode(F.transform(others, lambda k: F.xxhash64("key", F.least(part, k), F.greatest(part, k))))
    small = placed.where("parts = 1").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "rep", "root")
    dealt = saved(small.unionByName(placed.where("parts > 1").select(split.alias("bucket"), "key", "rep", "root")), "open")
    members = dealt.select("bucket", "rep").distinct().join(reps, "rep").select(F.col("bucket").alias("own_bucket"), F.col("rep").alias("id"), F.col("n").alias("size"), F.col("sketch").alias("bits"))
    pairs = dealt.groupBy("bucket").cogroup(members.groupBy("own_bucket")).applyInArrow(lambda g, s: _bucket_pairs(g, s, top, forest), "a bigint, b bigint").distinct()
    pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(rooted, dealt)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 75, width: int = 5, block: int = BLOCK) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links, its own if none) of every row.

    Documents link when their shingle sets' Jaccard similarity is at least top %. Equal sets form a class first and one
    document stands for it. Candidate pairs are verified in rounds: two that take about one pair a document, whose links
    give components, and a last one with every pair left that joins a key and lies in two components, so that no link is
    lost. A null or empty text has no shingles and is alone; rows with one id count as one document of several texts; a
    null id stays alone with a null component; an empty table gives no rows.
    """
    size = int(str(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(16, min(size >> 22, 1 << 20))
    pair_buckets = max(16, buckets // 6)
    out = saved(sketch_pass(docs, id_col, text_col, buckets, top, width), "sketches", ROWS)
    each = out.where("bucket is null").select("doc_id", "n", "sig", "sketch")
    # classes of equal sets: only those with copies are joined back, salted
    copies = each.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = copies.select("sig", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["sig", "salt"], "left")
    each = saved(each.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")), F.col("sketch")).alias("sketch")), "classes")
    # an id with several texts is the set of the first of them here; all its texts are compared when pairs are verified
    reps = each.where("sketch is not null").groupBy(F.col("rep").alias("rep")).agg(F.min_by("n", "sketch").alias("n"), F.min("sketch").alias("sketch"))
    of = each.where("n > 0 and doc_id is not null").select("doc_id", "rep").distinct()
    groups = saved(key_groups(out.where("bucket is not null").select("bucket", "keys", "owners")).join(of, "doc_id").select("key", "rep").distinct(), "groups")
    # texts of one id stand for each other
    several = each.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    several = saved(several, "several")
    discard(out)
    roots, tried = None, None
    for forest in (0, 1, None):
        # in the last round few groups are left; fewer buckets repeat a pair less often
        pairs = open_pairs(groups, reps, roots, pair_buckets if forest is not None else max(4, pair_buckets // 4), top, forest, block, tried)
        links = linked(pairs, docs, id_col, text_col, top, width)
        last, roots = roots, components(links.unionByName(several) if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(links, last)
        tried = pairs if tried is None else tried.unionByName(pairs)
    discard(groups, several)
    out = each.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """A number for each (id, hash of the text) in their order, if some id has several texts; None if none has."""
    seen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).where("id is not null")
    if not seen.groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo < hi").limit(1).count():
        return None
    return saved(seen.distinct().repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "hash", F.monotonically_increasing_id().alias("key")), "rows")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 75, width: int = 5) -> DataFrame:
    """The rows of docs with one document of each near-duplicate group, that of the smallest id; columns stay.

    Repeated rows (equal id and text) give one row. Rows that share an id but not a text are documents of their own, the
    one of the smaller hash first. Rows without shingles or without an id all stay; an empty table gives no rows. Extra
    columns may have any names. Only rows that a bitmap of bounded size can't clear are shuffled, so most texts aren't moved.
    """
    columns, key = docs.columns, unused(docs.columns, "near_key")
    numbers = _row_keys(docs, id_col, text_col)
    if numbers is None:
        keyed = docs.withColumn(key, F.col(id_col).cast("bigint"))
    else:
        hashed = f"{key}_own"
        numbers = numbers.select(F.col("id").alias(f"{key}_id"), F.col("hash").alias(f"{key}_hash"), F.col("key").alias(key))
        keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(numbers, (F.col(id_col).cast("bigint") == F.col(f"{key}_id")) & (F.col(hashed) == F.col(f"{key}_hash")), "left")
        keyed = saved(keyed.select(*(F.col(f"`{c}`") for c in columns), key), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("id"), F.col(text_col).alias("text")), "id", "text", top, width).where("id is not null")
    fate = found.groupBy("id").agg(F.count("*").alias("rows"), F.max(F.col("component_id") != F.col("id")).alias("goes")).where("rows > 1 or goes")
    fate = saved(fate.select(F.col("id").alias(f"{key}_id"), F.col("goes").alias(f"{key}_goes")), "fate")
    bits = _id_filter(fate.select(f"{key}_id"))
    if bits is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names, at, maybe = keyed.columns, keyed.columns.index(key), f"{key}_maybe"

    def mark(batch: pa.RecordBatch) -> dict:
        ids = batch.column(at)
        spot = mix64(np.asarray(ids.fill_null(-1)).view(U)) & U(8 * len(shared.value) - 1)
        hit = np.frombuffer(shared.value, np.uint8)[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8) & 1
        return {n: batch.column(i) for i, n in enumerate(names)} | {maybe: (hit > 0) & ~np.asarray(ids.is_null())}

    marked = arrow_map(keyed, mark, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), f"`{maybe}` boolean"]))
    doubtful = marked.where(F.col(maybe)).join(fate, F.col(key) == F.col(f"{key}_id"), "left").where(~F.coalesce(F.col(f"{key}_goes"), F.lit(False))).dropDuplicates([key])
    back = [F.col(f"`{c}`") for c in columns]
    return marked.where(~F.col(maybe)).select(*back).unionByName(doubtful.select(*back))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
