"""Operator 10, personal data, in DataFrame functions only: pattern spans, and terms that disclose them.

Besides the pattern kinds, all terms of the texts that hold a found value are held against it: over all texts of the
corpus, a term discloses a value when its pointwise mutual information with the value reaches a share of the value's
information content. Such terms are removed wherever they occur, or generalised where the share is lower.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import discard, saved, table, unused

#: Fixed values. Possessive repeats and a start at a run's beginning (or where the last match ended) keep matching linear;
#: the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a text cannot match.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = (*PATTERNS, "term")
#: Stands for the word characters of a found span, so that no term reaches into one.
HIDDEN = "\uffff"
TERM = r"(?<=[^\p{L}\p{N}_\x{FFFF}])\p{L}[\p{L}\p{N}_]{3,}(?=[^\p{L}\p{N}_\x{FFFF}])"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
PLACES = "array<struct<term:bigint,start:int,end:int>>"
SALTS = 16
#: One in so many texts is counted before all are, to leave out terms that are too common to disclose.
EARLY = 4


def spans_of(text: Column, pattern: str, kind: int, offset: Column | int = 0) -> Column:
    """(start, kind, end, value) of all matches in code points: what lies between matches gives their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.lit(offset) if isinstance(offset, int) else offset

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["found"])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), x["found"].alias("value")))).alias("spans"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("found"))
    pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found")))
    return F.aggregate(pairs, F.struct(start.cast("int").alias("at"), F.lit(None).cast(SPAN).alias("spans")), lambda a, x: step(F.struct(a["at"].alias("at"), F.coalesce(a["spans"], F.array().cast(SPAN)).alias("spans")), x))["spans"]


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, "[^0-9]", ""))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(p.rlike("^0+$"), 0).otherwise(256)) <= 255),
    "card": lambda v: _digits(v).between(14, 19) & _luhn(v),
    "phone": lambda v: _digits(v).between(10, 15),
}


def _valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: VALID[kind](s["value"]))


def base_spans(text: Column) -> Column:
    """All valid spans of the four pattern kinds by start and kind; null where there is none."""
    none = F.array().cast(SPAN)
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        can = text.rlike(pattern)
        if kind in SIGNS:
            can = text.contains(SIGNS[kind]) & can
        spans = _valid(spans_of(text, pattern, k), kind)
        parts.append(F.when(can, F.coalesce(spans, none)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _open_text(text: Column, base: Column) -> Column:
    """The text between two blanks, code point for code point, with the word characters of its spans hidden."""
    text = F.replace(text, F.lit(HIDDEN), F.lit(" "))

    def step(a: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], a["at"])
        gap, value = F.substring(text, a["at"] + 1, begin - a["at"]), F.substring(text, begin + 1, s["end"] - begin)
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.regexp_replace(value, r"[\p{L}\p{N}_]", HIDDEN)).alias("out")))

    done = F.aggregate(base, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    hidden = F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    return F.concat(F.lit(" "), F.when(F.size(base) > 0, hidden).otherwise(text), F.lit(" "))


def _places(padded: Column, maybe) -> Column:
    """term, start and end of the terms of a text between blanks that may disclose; null where there is none."""
    found, between = F.regexp_extract_all(padded, F.lit(TERM), F.lit(0)), F.split(padded, TERM, -1)
    none = F.array().cast(PLACES)

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["found"])
        place = F.struct(hash_of(x["found"]).alias("term"), begin.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(maybe(hash_of(x["found"])), F.concat(a["places"], F.array(place))).otherwise(a["places"]).alias("places"))

    pairs = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("found")), lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found")))
    start = F.struct(F.lit(-1).alias("at"), F.lit(None).cast(PLACES).alias("places"))  # the blank before the text
    told = F.aggregate(pairs, start, lambda a, x: step(F.struct(a["at"].alias("at"), F.coalesce(a["places"], none).alias("places")), x))["places"]
    return F.when(F.exists(found, lambda t: maybe(hash_of(t))), told)


def hash_of(x: Column) -> Column:
    """What terms and values are told apart by, whatever their case."""
    return F.xxhash64(F.lower(x))


def _hash_filter(hashes: DataFrame, max_bits: int = 20):
    """A test of hashes against a bitmap of at most 2^max_bits bits whatever their number; None if there are none."""
    n = hashes.count()
    if not n:
        return None
    log = min(max_bits, max(13, (256 * n).bit_length()))
    place = lambda h: h.bitwiseAND(F.lit((1 << log) - 1))
    at = hashes.toDF("h").select(place(F.col("h")).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = ["0"] * (1 << (log - 6))
    for r in at.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["word"]] = str(r["bits"])
    bits = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")  # folded to a literal
    return lambda h: F.getbit(F.get(bits, F.shiftright(place(h), 6).cast("int")), place(h).bitwiseAND(F.lit(63)).cast("int")) == 1


def _share(n_both: Column, n_term: Column, n_entity: Column, n: int) -> Column:
    """Share of a value's information content that a term gives away: their pointwise mutual information over it, less
    log(n) / (2 n_both) for what chance may do: among n texts so many terms meet a value that p(value | term) is taken at
    its lower bound, n_both / n_term * n ** (-1 / (2 n_both))."""
    content = F.log(F.lit(float(n)) / n_entity)
    return 1 - (F.log(n_term / n_both) + math.log(max(n, 1)) * 0.5 / n_both) / F.nullif(content, F.lit(0.0))


def told_pairs(told: DataFrame, n: int, generalise_at: float) -> DataFrame | None:
    """entity, term, n_both, n_entity of pairs that may disclose, judged by the texts with values alone; None if none can.

    told holds hashes of the entities and terms of the distinct texts with values. A term is in no fewer texts of the corpus
    than of these, so the share here is an upper bound; common words fall out before the corpus is counted. Entities and
    terms of too few texts are passed over by bitmaps before pairs are made.
    """
    least = max(1, math.ceil(0.5 / max(1 - generalise_at, 1e-9)))  # fewer texts of both can't reach the share
    if generalise_at < 1 and least * (1 - generalise_at) == 0.5 and least > 1:
        least += 1  # a value of two texts or more has less content than log(n)
    values = told.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least)
    terms = told.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_told")).where(F.col("n_told") >= least)
    value, term = _hash_filter(values.select("entity")), _hash_filter(terms.select("term"))
    if value is None or term is None:
        return None
    both = told.select(F.explode(F.filter("entities", value)).alias("entity"), F.filter("terms", term).alias("terms")).select("entity", F.explode("terms").alias("term"))
    both = both.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    both = both.join(values, "entity").join(terms, "term").where(_share(F.col("n_both"), F.col("n_told"), F.col("n_entity"), n) >= generalise_at)
    return both.select("entity", "term", "n_both", "n_entity")


def _found(docs: DataFrame, text_col: str, remove_at: float, generalise_at: float) -> DataFrame:
    """All columns of docs with pii_base and pii_terms (pii_ with more underscores if taken), row by row."""
    pii = unused(docs.columns, "pii_")
    row, key, base, opened, places, out = (pii + x for x in ("row", "hash", "base", "open", "places", "terms"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashes = lambda words: F.array_distinct(F.transform(words, hash_of))

    def spanned(df: DataFrame) -> DataFrame:
        return df.withColumn(key, F.xxhash64(text)).withColumn(base, base_spans(text))

    first = spanned(docs.select(F.col(f"`{text_col}`")))
    holds = F.size(base) > 0
    early = F.pmod(key, F.lit(EARLY)) == 0
    first = first.select(F.col(key).alias("hash"), F.when(holds, hashes(F.col(f"{base}.value"))).alias("entities"), F.when(holds | early, hashes(F.regexp_extract_all(_open_text(text, F.col(base)), F.lit(TERM), F.lit(0)))).alias("terms"))
    first = saved(first, "pii-first")
    n = first.select("hash").distinct().count()
    texts = saved(first.where("terms is not null").groupBy("hash").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "pii-told")
    discard(first)
    told = texts.where("entities is not null")
    pairs = told_pairs(told, max(n, 1), generalise_at)
    if pairs is not None:
        pairs = saved(pairs, "pii-pairs")
        if (likely := _hash_filter(pairs.select("term").distinct())) is not None:
            # the counts of a part of the corpus bound those of all from below, so what falls out here can't disclose
            some = texts.select(F.explode(F.filter("terms", likely)).alias("term")).groupBy("term").agg(F.count("*").alias("n_some"))
            last, pairs = pairs, saved(pairs.join(some, "term").where(_share(F.col("n_both"), F.col("n_some"), F.col("n_entity"), n) >= generalise_at).drop("n_some"), "pii-pairs")
            discard(last)
    discard(texts)
    none, maybe = F.array().cast("array<struct<start:int,end:int,action:string>>"), None if pairs is None else _hash_filter(pairs.select("term").distinct())
    if maybe is None:
        return spanned(docs).withColumn(out, none).drop(key)
    rows = spanned(docs).withColumn(opened, _open_text(text, F.col(base))).withColumn(places, _places(F.col(opened), maybe)).drop(opened)
    rows = saved(rows.withColumn(row, F.monotonically_increasing_id()), "pii")
    # document frequencies over distinct texts; the filter lets a few other terms through, which join with nothing
    seen = rows.where(F.col(places).isNotNull()).select(key, F.explode(F.array_distinct(f"{places}.term")).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    share = _share(F.col("n_both"), F.col("n_term"), F.col("n_entity"), n)
    # "remove" sorts after "generalise" and wins
    action = F.max(F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")).alias("action")
    told = saved(pairs.join(seen, "term").withColumn("share", share).where(F.col("share") >= generalise_at).groupBy("term").agg(action), "pii-terms")
    discard(pairs)
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = rows.where(F.col(places).isNotNull()).select(F.col(row), F.explode(places).alias("p")).select(row, "p.*", F.pmod(row, F.lit(SALTS)).cast("int").alias("salt"))
    hits = hits.join(told, ["term", "salt"]).groupBy(row).agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias(out))
    back = [F.col(f"`{c}`") for c in (*docs.columns, base)]
    plain = rows.where(F.col(places).isNull()).select(*back, none.alias(out))
    return plain.unionByName(rows.where(F.col(places).isNotNull()).join(hits, row, "left").select(*back, F.coalesce(out, none).alias(out)))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.9, generalise_at: float = 0.75) -> DataFrame:
    """id, base (pattern spans) and terms (disclosing terms: start, end, action) of every text.

    Counts are of distinct whole texts, so copies of a text weigh once; texts, terms and values are told apart by 64-bit
    hashes. A term discloses a value when the share of the
    value's information that it gives away (see _share) reaches generalise_at; from remove_at on it is removed. What was
    seen together once or twice discloses nothing, however rare, in a corpus of any size. A disclosing term is marked in every text, outside of pattern spans. A null text is empty; repeated rows each
    come back with the same spans; a null id is kept; other columns aren't read; an empty table gives no rows. Equal starts
    are ordered by kind.
    """
    found = _found(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", remove_at, generalise_at)
    return found.select(F.col(id_col), F.col(found.columns[-2]).alias("base"), F.col(found.columns[-1]).alias("terms"))


def sanitise(docs: DataFrame, text_col: str = "text", remove_at: float = 0.9, generalise_at: float = 0.75) -> DataFrame:
    """The rows of docs with pattern spans and disclosing terms replaced by [kind], terms to remove by nothing.

    Spans stay beside their row, so ids play no part: rows without one, or that share one, are each made clean, and
    repeated rows alike. Columns stay, whatever their names; a null text stays null; an empty table gives no rows.
    """
    found = _found(docs, text_col, remove_at, generalise_at)
    base, terms = found.columns[-2:]
    names = F.array(*[F.lit(k) for k in PATTERNS])
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("by"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise("[term]").alias("by"))),
    ))
    text = F.col(f"`{text_col}`")

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(gap, s["by"])).otherwise("")).alias("out")))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    done = F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    fixed = F.when(F.size(base) + F.size(terms) > 0, done).otherwise(text)
    return found.select(*[fixed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    all_spans = F.array_sort(F.concat(F.transform("base", place), F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)],
        F.sha2(F.array_join(F.transform("base", said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(all_spans, said), ",").alias("spans"),
    )
