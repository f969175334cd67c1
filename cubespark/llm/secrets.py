"""Operator 1, secret scans: a trigram inverted index narrows each rule to candidate texts."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cubespark.llm.common import arrow_map, table, text_bytes
from cubespark.llm.trigram import Vocabulary, candidates, derive, postings


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts when the group has at least min_length characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    ignore_case: bool = False


#: The three base kinds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of provider credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
)


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_length]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_bytes: int = 8 << 20) -> DataFrame:
    """All secrets of all texts: id and spans, an array of (kind, start, end) in code points by start and rule order.

    Texts are indexed in blocks of about block_bytes: postings of the trigrams that rules mention are intersected to
    candidates, which the rule's regex verifies; a rule without mandatory trigrams (hex) scans every text. A null text
    is empty; every row, repeated ones too, gives one row; other columns are not read, so their names cannot clash.
    """
    queries = [derive(r.pattern) for r in rules]
    vocabulary = Vocabulary(queries)
    compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]

    def block(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        lists = postings(vocabulary, texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in candidates(query, vocabulary, lists, len(texts)).tolist():
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "replace")
                spans[i] += [(start, k, end) for start, end in find(rule, regex, decoded[i])]
        return spans

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in text_bytes(batch.column(1))]
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= block_bytes):
                size += len(texts[to])
                to += 1
            out += block(texts[at:to])
            at = to
        return {id_col: batch.column(0), "spans": [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in out]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The rows with each secret in the text replaced by [kind]; columns and their order stay, whatever their names.

    Null and empty texts stay as they are; repeated rows are treated alike; of overlapping secrets the first is named and
    all are taken out; an empty table gives no rows.
    """
    scan = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0))) for r in rules]
    queries = [derive(r.pattern) for r in rules]
    vocabulary = Vocabulary(queries)
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> dict:
        raw = text_bytes(batch.column(at))
        lists = postings(vocabulary, [t or b"" for t in raw])
        found: dict[int, list[tuple[int, int, str]]] = {}
        for (rule, regex), query in zip(scan, queries, strict=True):
            for i in candidates(query, vocabulary, lists, len(raw)).tolist():
                if raw[i]:
                    if spans := find(rule, regex, raw[i].decode("utf-8", "replace")):
                        found.setdefault(i, []).extend((s, e, rule.kind) for s, e in spans)
        for i, spans in found.items():
            text, out, done = raw[i].decode("utf-8", "replace"), [], 0
            for s, e, kind in sorted(spans):
                if e > done:
                    if s >= done:
                        out.append(text[done:s] + f"[{kind}]")
                    done = e
            raw[i] = ("".join(out) + text[done:]).encode()
        return {n: raw if n == text_col else batch.column(j) for j, n in enumerate(names)}

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), slice_bytes=4 << 20)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {r.kind for r in BASE_RULES}
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for spans in batch.column(1).to_pylist():
            said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
            for kind in ("assign", "access", "hex"):
                out[f"n_{kind}"].append(sum(k == kind for k, _ in said))
            out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in said if k in base).encode()).hexdigest())
            out["spans"].append(",".join(x for _, x in said))
        return {"doc_id": batch.column(0)} | out

    return arrow_map(found, run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
