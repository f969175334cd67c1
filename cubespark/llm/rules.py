"""Operator 5, quality rules with host verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import arrow_map, saved, table, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of the width that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    size, code = len(ids), w[: n - width + 1]
    for k in range(1, width):
        code = code * size + w[k : n - width + 1 + k]
        if size ** (k + 2) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = twice.copy()
    for k in range(1, width):
        hit[k:] |= twice[:-k]
    return int(hit.sum())


def features(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    continuation = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    chars = len(text) - continuation - (len(text) - len(text.translate(None, SPACES)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        rows = np.array([features(t) for t in text_bytes(batch.column(2))], np.int64).reshape(-1, 5)
        return {id_col: batch.column(0), "host": batch.column(1)} | {n: rows[:, i] for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(host_col).cast("string").alias("host"), F.col(text_col))
    return arrow_map(picked, run, f"`{id_col}` {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint")


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by a beta prior fitted to all hosts by moments.

    The prior's mean is the overall rate; its strength comes from the spread of the hosts' rates beyond what sampling
    explains. All sums are partial sums first, so a host with a third of the rows costs one row a task.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("bigint")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    prior = hosts.agg(
        (F.sum("failures") / F.sum("docs")).alias("m"),
        F.count("*").alias("n_hosts"), F.sum("docs").alias("n"),
        F.sum(F.col("docs") * rate * rate).alias("q"), F.sum(F.col("docs") * F.col("docs").cast("double")).alias("n2"),
    )
    m, n, k = F.col("m"), F.col("n").cast("double"), F.col("n_hosts")
    between = (F.col("q") - n * m * m - (k - 1) * m * (1 - m)) / F.nullif(n - F.col("n2") / n, F.lit(0.0))
    strength = F.when((m <= 0) | (m >= 1), F.lit(1.0)).when(F.coalesce(between, F.lit(0.0)) <= 0, n).otherwise(F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), n))
    prior = prior.select(m.alias("prior_mean"), strength.alias("prior_strength"))
    # one row: the cross side is a global aggregate
    both = hosts.crossJoin(F.broadcast(prior))
    return both.select("host", "docs", "failures", "prior_mean", "prior_strength", ((F.col("failures") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("docs") + F.col("prior_strength"))).alias("host_rate"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.6) -> DataFrame:
    """Rules of every document, and a verdict of its host joined back.

    A document fails with fewer than min_words words or more than max_repeat_percent % of its words in repeated 3-word
    windows. A host whose shrunk failure rate is over max_host_rate is rejected with all it holds. A null text has no
    words and fails; documents with a null host share one host; repeated rows count each; an empty table gives none.
    """
    measured = saved(measure(docs, id_col, text_col, host_col).withColumn("failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))), "rules")
    hosts = saved(host_rates(measured), "hosts")
    rates = hosts.select(F.coalesce("host", F.lit("")).alias("_h"), F.col("host").isNull().alias("_null"), "host_rate")
    # Salted by row, so that a host with a third of the documents is dealt over many tasks; of hosts with at least one
    # document in a thousand, which are at most a thousand, there is a copy a salt.
    salts, total = 32, hosts.agg(F.sum("docs")).first()[0] or 0
    hot = [r[0] for r in hosts.where(F.col("docs") * 1000 >= total).select(F.coalesce("host", F.lit(""))).collect()]
    rates = rates.withColumn("_salt", F.explode(F.when(F.col("_h").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    rows = measured.withColumns({"_h": F.coalesce("host", F.lit("")), "_null": F.col("host").isNull()})
    rows = rows.withColumn("_salt", F.when(F.col("_h").isin(hot), F.pmod(F.xxhash64(id_col, "word_chars", "n_symbols"), F.lit(salts)).cast("int")).otherwise(0))
    return rows.join(rates, ["_h", "_null", "_salt"], "left").drop("_h", "_null", "_salt").withColumn("host_kept", F.coalesce(F.col("host_rate") <= max_host_rate, F.lit(True)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("host_kept")).alias("kept"))


OP5_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
lines as (
  select r, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
tri as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select r, words, unnest(generate_series(1, len(words) - 2)) as i from w where len(words) > 2)),
hit as (
  select r, count(distinct i + k) as n_repeat_words
  from (select r, i, count(*) over (partition by r, g) as c from tri), (select unnest([0, 1, 2]) as k) where c > 1 group by r),
f as (
  select doc_id, source, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join lines using (r) left join hit using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
h as (select source, cast(count(*) as double) as docs, cast(sum(base_failed::int) as double) as failures from b group by source),
p as (
  select sum(failures) / sum(docs) as m, count(*) as k, sum(docs) as n, sum(failures * failures / docs) as q, sum(docs * docs) as n2 from h),
s as (
  select m, case when m <= 0 or m >= 1 then 1.0
                 when coalesce(bt, 0) <= 0 then n else least(greatest(m * (1 - m) / bt - 1, 1.0), n) end as strength
  from (select m, n, (q - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - n2 / n, 0) as bt from p)),
v as (select source, (failures + m * strength) / (docs + strength) <= 0.6 as ok from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and v.ok as kept
from b join v on b.source is not distinct from v.source
"""
