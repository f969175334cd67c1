"""Near duplicates, decontamination, packing, archives and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubespark.llm import components, decontaminate, fmindex, near, packing, warc


def plain_components(docs, top=75):
    sets, root = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None and sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= top * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, folder, docs):
    want = plain_components(docs)
    got = near.op7_ngram_jaccard(spark, folder).collect()
    assert len(got) == len(docs)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_near_duplicates_of_all_sizes(spark):
    """Chains of edits at every size: links lie on both sides of the threshold."""
    rng, rows = np.random.default_rng(6), []
    for size in (1, 3, 5, 6, 7, 8, 12, 20, 40, 70, 130, 260, 520, 600):
        words = [f"w{x}" for x in rng.integers(0, 10**9, size)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in rng.integers(0, len(words), max(1, size // 45)):
                words[at] = f"e{rng.integers(10**9)}"
            words += [f"t{rng.integers(10**9)}" for _ in range(size // 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()} == want


def test_small_sets_share_a_key():
    """All shingles in one segment of the sketch, and random linked pairs of few shingles."""
    rng = np.random.default_rng(3)
    pairs = [(np.array([1, 2, 3], np.uint64), np.array([1, 2, 3, 4], np.uint64))]
    for n in [3] * 3000 + [4, 6, 9] * 200:
        b = np.unique(rng.integers(0, 1 << 63, n + 1).astype(np.uint64) << np.uint64(1))
        pairs.append((np.delete(b, rng.integers(len(b))), b))
    assert all(np.intersect1d(near.keys(a), near.keys(b)).size for a, b in pairs)


def test_texts_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in near.near_duplicates(df).collect()} == {3}


def test_one_of_each_stays(spark, edge_docs, empty):
    kept = near.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["doc_id"]) for r in edge_docs.collect()})
    assert near.keep_one(empty).count() == 0
    rows = [(i, " ".join(f"w{k}" for k in range(40)), i, 1, "x", 2, 3) for i in range(5, 30)] + [(50, "something else altogether", 0, 1, "y", 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _maybe int, _id int, _DROP string, near_key int, `near_key__id` int")
    kept = near.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 50] and kept.schema == df.schema


def test_rows_that_share_an_id_stay(spark):
    """Different texts under one id are documents of their own; copies of a row and of a text go."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a, 1), (3, a, 1), (7, a, 2), (7, b, 2), (9, b, 3), (9, c, 3), (None, c, 4), (11, None, 5), (11, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.keep_one(df).collect()) == [(0, c), (3, a), (7, b), (9, c), (11, "")]


def test_groups_in_blocks(spark):
    """Groups of more members than a block, whose keys many share: links and what has none come out as without blocks."""
    rng, rows = np.random.default_rng(8), []
    stem = [f"s{k}" for k in range(120)]
    for k in range(90):  # chains of edits around one text, some far from all others
        words = list(stem)
        for at in rng.integers(0, 120, 1 + k % 9):
            words[at] = f"e{rng.integers(6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert 1 < len({r for _, r in want.values()}) < 80
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, block=7).collect()} == want


@pytest.mark.parametrize("n", range(1, 65))
def test_linked_sets_share_a_key(n):
    """Sets of every small size against hostile partners: all that may differ falls into the fewest segments there are."""
    rng = np.random.default_rng(n)
    for k in range(60):
        spread = 64 - int(rng.integers(0, 13))  # the low bits alone vary: many members a segment
        both = (rng.integers(0, 1 << 62, n).astype(np.uint64) >> np.uint64(64 - spread)) | (rng.integers(0, 1 << 3, 1).astype(np.uint64) << np.uint64(spread - 1 if spread < 64 else 61))
        both = np.unique(both)
        for more in range(len(both) // 3 + 1):
            fresh = np.setdiff1d(np.unique(rng.integers(0, 1 << 62, more).astype(np.uint64) >> np.uint64(64 - spread)), both)
            mine, yours = np.sort(np.concatenate((both, fresh[::2]))), np.sort(np.concatenate((both, fresh[1::2])))
            if 100 * len(both) >= 75 * (len(mine) + len(yours) - len(both)):
                assert np.intersect1d(near.keys(mine), near.keys(yours)).size


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n * 2 // 3], rng.integers(0, 1 << 63, n).astype(np.uint64))))
        assert near.sketch_distance(near.short_sketch(a), near.short_sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 101: 100}


def plain_hits(text, bench):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, items = cut(text), set(), set()
    for item, t in bench:
        w = cut(t)
        size = min(10, len(w))
        phrases = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1) if size else ():
            if tuple(words[k : k + size]) in phrases:
                hit |= set(range(k, k + size))
                items.add(item)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, folder, docs):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = decontaminate.op8_decontamination(spark, folder).collect()
    want = sorted((str(i), *plain_hits(t, bench)) for i, t in docs)
    assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in got) == want
    assert any(w[-1] for w in want)


def test_benchmark_in_parts(spark, folder, edge_docs, empty):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 900000"), spark.read.parquet(f"{folder}/benchmark.parquet")
    told = lambda df: sorted(map(str, df.select("doc_id", "n_words", "spans", "items").collect()))
    assert told(decontaminate.find_contamination(docs, bench)) == told(decontaminate.find_contamination(docs, bench, max_benchmark_bytes=4000))
    rows = lambda **k: sorted(map(str, decontaminate.remove_contamination(docs.withColumn("found", F.lit(1)), bench, **k).collect()))
    assert rows() == rows(max_benchmark_bytes=4000) != sorted(map(str, docs.withColumn("found", F.lit(1)).collect()))
    nothing = bench.limit(0)
    assert {len(r["items"]) for r in decontaminate.find_contamination(edge_docs, nothing).collect()} == {0}
    assert decontaminate.find_contamination(empty, bench).count() == decontaminate.remove_contamination(empty, bench).count() == 0
    assert sorted(map(str, decontaminate.remove_contamination(edge_docs, nothing).collect())) == sorted(map(str, edge_docs.collect()))
    assert decontaminate.remove_contamination(edge_docs, bench).count() == edge_docs.count()


def test_rows_of_one_id_in_parts(spark):
    """Texts that share an id, or have none, come back one by one whatever the benchmark's size."""
    words = [f"word{k}" for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(words[k : k + 10])) for k in range(0, 40, 5)], "item_id long, text string")
    rows = [(1, " ".join(words[:20])), (1, "none of them " * 9), (None, " ".join(words[10:30])), (None, "short"), (2, "twice"), (2, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda **k: sorted(map(str, decontaminate.find_contamination(df, bench, **k).collect()))
    assert len(told()) == 6 and told(max_benchmark_bytes=300) == told()


def test_spans_removed(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep. Alpha, BETA gamma-delta! End", 7), (2, None, 7), (3, "alpha beta gamma", 7)], "doc_id long, text string, items int")
    assert [tuple(r) for r in decontaminate.remove_contamination(df, bench).orderBy("doc_id").collect()] == [(1, "Keep. ! End", 7), (2, None, 7), (3, "alpha beta gamma", 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_all(text, pattern):
    index = fmindex.FMIndex(np.array(text, np.int64), 5, sample=3)
    low, high = index.search(np.array([pattern]))
    want = [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_packs_places_all(histogram):
    plan = packing.plan_packs(histogram, 64)
    placed = {}
    for count, pattern in plan:
        assert sum(pattern) <= 64
        for x in pattern:
            placed[x] = placed.get(x, 0) + count
    assert placed == histogram


def test_tokens_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path, memo=50)
    texts = ["", "it's I'd WE'RE 123 !!'s ''d", "''s 's's !'s 'sting 're'll x'", "a<|endoftext|>b", "İx ΣΑΣ é é", "\xa0\x85\x1c a\x0bb", "日本 ½²", "x" * 200 + " 12ab", "'", "\n'\n", "ﬁn ŉ ǆ"]
    for _ in range(3):
        assert [np.frombuffer(b, "<u4").tolist() for b in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_all_latin_letters():
    """Every code point up to U+024F in several contexts, and random mixes with other scripts: lower case may leave the table."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [t for x in map(chr, range(0x250)) for t in (f"ab{x}cd", f"a'{x}b", x, f"{x}{x}1{x}s", f" {x} 's{x} '{x}s")]
    rng = np.random.default_rng(5)
    pool = np.array([*map(chr, range(1, 0x250)), *[" ", "'", "s", "t", "re", "\n", "a", "1"] * 40, "日", "Σ", "\u0301", "\u0307", "\u212a"], object)
    texts += ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_packs_takes_the_shortest(lengths):
    """Sizes of the packs are those of placing pieces one by one, longest first, each in the shortest pack that takes it."""
    packs = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, p in enumerate(packs) if sum(p) + x <= 40]
        if fits:
            packs[min(fits, key=lambda k: sum(packs[k]))].append(x)
        else:
            packs.append([x])
    plan = packing.plan_packs({x: lengths.count(x) for x in lengths}, 40)
    assert sorted(sum(p) for n, p in plan for _ in range(n)) == sorted(map(sum, packs))


def test_packing(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = packing.op4_packing(spark, folder).collect()
    ids = {}
    for i, t in docs:
        ids[i] = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, p in pieces.items():
        copies = 2 if i == 900005 else 1
        assert sum(n for _, n in p) == copies * len(ids[i])
    assert set(pieces) == set(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(len(x) for x in ids.values()) > 0.9 * 2048 * len(sequences)


def test_pack_edges(spark, edge_docs, empty):
    assert packing.pack_documents(empty).count() == 0
    out = packing.pack_documents(edge_docs, keep_ids=True)
    assert all(len(r["ids"]) == 4 * r["length"] for r in out.collect())


def test_archives(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = warc.op9_warc(spark, folder).collect()
    first = {}
    for p in pages:
        b = (p["html"] or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, p["page_id"]), p["page_id"])
    want = []
    for p in pages:
        b = (p["html"] or "").encode()
        other = first.get(b, p["page_id"])
        again = other != p["page_id"]
        want.append((p["page_id"], len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", other if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archives_are_rolled_and_checked(spark, tmp_path):
    """Files stay small, odd rows come back, an empty table gives nothing, a revisit of nothing raises."""
    rows = [(i, f"http://{i}", ("é" * 70 if i % 3 else "x" * 200) + str(i % 5)) for i in range(60)] + [(None, None, "é" * 70 + "1"), (None, "u", None), (70, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.with_origin(pages.coalesce(1), "page_id", "html", 100), f"{tmp_path}/a", archive_bytes=2000)
    assert len(list((tmp_path / "a").glob("part-*"))) > 3
    got = warc.read_archives(spark, f"{tmp_path}/a")
    warc.check_revisits(got)
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_digest"]) for r in got.collect()) == sorted((i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, _, t in rows)
    with pytest.raises(warc.WarcError):
        warc.check_revisits(got.where("record_type = 'revisit'"))
    warc.write_archives(warc.with_origin(pages.limit(0), "page_id", "html", 100), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_bad_archives():
    one = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(b"hi").hexdigest()), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"hi").hexdigest())], b"hi")
    assert [warc.parse(m)[1] for m in warc.members(one + one + b"\n" + one, chunk=7)] == [b"hi"] * 3
    with pytest.raises(warc.WarcError):
        list(warc.members(one[:-5]))
    bad = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha256:00")], b"hi")
    with pytest.raises(warc.WarcError):
        warc.parse(next(warc.members(bad)))
    with pytest.raises(warc.WarcError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nhi\r\n\r\n")


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 900001 not in seen["quality"] and set(seen["near_duplicates"]) < set(seen["quality"]) | {None}
    want = plain_components(list(seen["quality"].items()))
    assert set(seen["near_duplicates"]) == {i for i, (_, root) in want.items() if i is None or root == i}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for i, t in seen["near_duplicates"].items():
        if len(t) < 100_000 and not plain_hits(t, bench)[-1]:
            assert seen["decontaminate"][i] == t
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == set(seen["secrets"])


def test_pipeline_of_an_empty_table(spark, folder, empty, tmp_path):
    import corpus_pipeline

    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    empty.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_any_columns(spark, folder, edge_docs):
    import corpus_pipeline

    docs, before = edge_docs.withColumn("quality_score", F.lit("mine")), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [*edge_docs.columns, "quality_score"]
    assert {r["quality_score"] for r in docs.collect()} == {"mine"} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
