"""Secrets in texts, found through a trigram index.

Each rule's regular expression is read into a Boolean query over trigrams that any match
must contain. A segment (some documents of one partition) gets an inverted index from
trigram to documents, for the trigrams that rules ask for; a rule's postings are
intersected and united, and only the candidates are searched with the expression. A rule
without mandatory trigrams is searched in every document. Nothing is shuffled, and a
segment's index is bounded by the segment.

Null and empty texts have no spans; every row is kept; rows don't depend on each other.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

try:  # the parser of regular expressions, by its name since Python 3.11
    from re import _constants as C
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group, fewer don't count


#: The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the method adds: keys of well-known public formats.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
SEGMENT_BYTES = 4 << 20
MOST_STRINGS = 32


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """What any match must contain: all of these clauses; of a clause, one alternative with all its trigrams. Lower case."""
    clauses: list[list[list[str]]] = []

    def grams(s: str) -> list[str]:
        return [s[i : i + 3] for i in range(len(s) - 2)]

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append(sorted(grams(s) for s in strings))

    def strings_of(items) -> set[str] | None:
        """All strings that a part can match, if they are few."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                got = {chr(arg).lower()}
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                got = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                got = strings_of(arg[3])
            elif op is C.BRANCH:
                each = [strings_of(x) for x in arg[1]]
                got = None if None in each else set().union(*each)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and tuple(map(int, arg[:2])) == (0, 1):
                got = strings_of(arg[2])
                got = None if got is None else got | {""}
            else:
                got = None
            if got is None or len(out) * len(got) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in got}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            got = strings_of([item])
            if got is not None and len(run) * len(got) <= MOST_STRINGS:
                run = {a + b for a in run for b in got}
                continue
            flush(run)
            run = {""}
            op, arg = item
            if op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and int(arg[0]) >= 1:
                walk(arg[2])
            elif got is not None:
                run = got
        flush(run)

    walk(sre_parse.parse(pattern, re.ASCII))
    return clauses


class Segment:
    """The inverted index of some texts: for each wanted trigram, the numbers of the texts that contain it."""

    def __init__(self, texts: list[bytes], number_of: np.ndarray, n_trigrams: int):
        self.n = len(texts)
        joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0\0", np.uint8).astype(np.uint32)
        codes = joined[:-2] << np.uint32(16) | joined[1:-1] << np.uint32(8) | joined[2:]
        wanted = number_of[codes]
        at = np.flatnonzero(wanted)
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
        doc = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(wanted[at].astype(np.int64) * (self.n + 1) + doc)
        which, docs = pairs // (self.n + 1), pairs % (self.n + 1)
        ends = np.searchsorted(which, np.arange(n_trigrams + 2))
        self.postings = [docs[ends[k] : ends[k + 1]] for k in range(n_trigrams + 1)]

    def candidates(self, clauses: list[list[list[int]]]) -> np.ndarray:
        """Texts that satisfy every clause; all of them if there is none."""
        found = None
        for clause in clauses:
            either = np.empty(0, np.int64)
            for all_of in clause:
                docs = None
                for k in sorted(all_of, key=lambda k: len(self.postings[k])):
                    docs = self.postings[k] if docs is None else np.intersect1d(docs, self.postings[k], assume_unique=True)
                either = np.union1d(either, docs)
            found = either if found is None else np.intersect1d(found, either, assume_unique=True)
        return np.arange(self.n) if found is None else found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        # trigrams of other than ASCII letters have no single code; a clause with one is left out
        queries = [[c for c in q if all(g.isascii() for alt in c for g in alt)] for q in queries]
        self.trigrams = sorted({g for q in queries for c in q for alt in c for g in alt})
        place = {g: i + 1 for i, g in enumerate(self.trigrams)}
        self.number_of = np.zeros(1 << 24, dtype=np.uint16)
        for g, i in place.items():
            a, b, c = g.encode()
            self.number_of[a << 16 | b << 8 | c] = i
        self.queries = [[[[place[g] for g in alt] for alt in c] for c in q] for q in queries]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, rule, end), by start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        lowered = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(lowered[last]) <= SEGMENT_BYTES):
                held += len(lowered[last])
                last += 1
            segment = Segment(lowered[first:last], self.number_of, len(self.trigrams))
            for k, (rule, find, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
                for i in segment.candidates(query).tolist():
                    out[first + i] += [(m.start(), k, m.end()) for m in find.finditer(texts[first + i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            first = last
        return [sorted(spans) for spans in out]


def _scan_batches(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = [[{"kind": rules[k].name, "start": s, "end": e, "text": t[s:e]} for s, k, e in spans] for t, spans in zip(texts, scanner.scan(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "secrets"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """doc_id and ``secrets``: array of (kind, start, end, text), by start and then by the order of the rules."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda it: _scan_batches(it, rules), "doc_id long, secrets array<struct<kind:string,start:long,end:long,text:string>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = [r.name for r in BASE_RULES]
    for batch in batches:
        rows = [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in batch.column("secrets").to_pylist()]
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        own = [[s for s in spans if s[0] in base] for spans in rows]
        columns = [batch.column("doc_id"), *(pa.array([sum(s[0] == k for s in spans) for spans in own], pa.int64()) for k in base)]
        columns += [pa.array([hashlib.sha256(line(spans).encode()).hexdigest() for spans in own]), pa.array([line(spans) for spans in rows])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op7_secret_scan(docs: DataFrame) -> DataFrame:
    return find_secrets(docs).mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
