"""Secret scans with a trigram inverted index.

Each rule is a regular expression. Its parse tree gives a Boolean query over trigrams that every match must satisfy: literal
stretches demand all their trigrams, alternatives any of theirs. A segment of documents (one Arrow batch of bounded bytes) is
indexed: its postings list, for each trigram that some rule asks for, the documents that hold it, letters in lower case. The
queries intersect and unite postings, and only the documents left are verified by the expression itself, over the whole text.
A rule without mandatory trigrams scans every document. Segments are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import bound_batches, id_and_text, pieces

ALL = ("all",)
_MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """`accept` sees a match and keeps or drops it; a dropped match is not tried again elsewhere."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)
    flags: int = re.ASCII


def _long(group: int, n: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= n


#: The base rules. `[0-9a-f]{16,}` finds the runs of `[0-9a-f]+` that have 16 characters or more.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         _long(2, 12), re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", _long(0, 18)),
    Rule("hex", r"[0-9a-f]{16,}"),
]
#: Further rules: key files, access tokens of well-known form, signed web tokens.
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """A Boolean query, ("all",), ("tri", t), ("and", q...) or ("or", q...), that the lower-cased text of any match satisfies."""
    exact, query = _concat(_parser.parse(pattern, flags))
    return _simple("and", [query, _demand(exact)])


def _simple(kind: str, parts: list[tuple]) -> tuple:
    if kind == "or" and ALL in parts:
        return ALL
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    if kind == "or":  # an alternative that demands more than another adds nothing
        held = [frozenset(p[1:] if p[0] == "and" else [p]) for p in parts]
        parts = [p for p, own in zip(parts, held, strict=True) if not any(other < own for other in held)]
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _demand(strings: frozenset[str]) -> tuple:
    """What a text that holds one of the strings must hold."""
    return _simple("or", [_simple("and", [("tri", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _concat(items) -> tuple[frozenset[str], tuple]:
    """(strings that the tail of the sequence can be, query for all before that tail)."""
    now, query = frozenset([""]), ALL
    for op, arg in items:
        strings, inner = _node(op, arg)
        query = _simple("and", [query, inner])
        if strings is None or len(now) * len(strings) > _MOST_STRINGS:
            query = _simple("and", [query, _demand(now)])
            now = strings if strings is not None and len(strings) <= _MOST_STRINGS else frozenset([""])
        else:
            now = frozenset(a + b for a in now for b in strings)
    return now, query


def _node(op, arg) -> tuple[frozenset[str] | None, tuple]:
    """(all strings that the node matches, or None if they are too many; query)."""
    if op is sre.LITERAL:
        return frozenset([_lower(arg)]), ALL
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return frozenset(_lower(c) for _, c in arg), ALL
    if op is sre.SUBPATTERN:
        strings, query = _concat(arg[3])
        # a tail is the whole sequence only when nothing was flushed before it
        return (strings, ALL) if query == ALL and _whole(arg[3]) else (None, _simple("and", [query, _demand(strings)]))
    if op is sre.BRANCH:
        found = [_concat(x) for x in arg[1]]
        if all(q == ALL and _whole(x) for (_, q), x in zip(found, arg[1], strict=True)):
            return frozenset().union(*(s for s, _ in found)), ALL
        return None, _simple("or", [_simple("and", [q, _demand(s)]) for s, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _concat(inner)
        if high == 1 and query == ALL and _whole(inner):
            return strings | {""} if low == 0 else strings, ALL
        return None, ALL if low == 0 else _simple("and", [query, _demand(strings)])
    return (frozenset([""]), ALL) if op is sre.AT else (None, ALL)


def _whole(items) -> bool:
    """Whether the strings of a sequence are all of it."""
    size = 1
    for op, arg in items:
        strings, _ = _node(op, arg)
        size *= len(strings) if strings is not None else _MOST_STRINGS + 1
    return size <= _MOST_STRINGS


def _lower(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(q) for q in query[1:]))


class Segment:
    """Postings of the wanted trigrams over the texts of one batch."""

    def __init__(self, texts: pa.Array, wanted: list[bytes], lookup: np.ndarray):
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
        self.rows = np.arange(len(texts))
        low = _LOWER[raw].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        number = lookup[code]
        at = np.flatnonzero(number)
        row = np.searchsorted(off - off[0], at, side="right") - 1
        at_, row = at[keep := at + 3 <= (off - off[0])[row + 1]], row[keep]
        held = np.unique(row.astype(np.int64) * (len(wanted) + 1) + number[at_])
        held_number = held % (len(wanted) + 1)
        self.postings = {t: held[held_number == k + 1] // (len(wanted) + 1) for k, t in enumerate(wanted)}

    def find(self, query: tuple) -> np.ndarray:
        """Rows of the segment that satisfy the query, ascending."""
        if query == ALL:
            return self.rows
        if query[0] == "tri":
            return self.postings[query[1].encode()]
        found = [self.find(q) for q in query[1:]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, spans array<struct<kind, start, end>> by start, then kind as listed in `rules`.

    Positions count code points, end exclusive. Within a kind, matches are leftmost and do not overlap. Null and empty texts
    have no spans. Rows are kept one for one, repeated rows too; other columns are not read. Whole texts are searched.
    """
    bound_batches(docs.sparkSession)
    rules = RULES if rules is None else rules
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted({t.encode() for q in queries if q != ALL for t in trigrams_of(q)})
    parts = [(r.kind, r.pattern, r.flags, r.accept) for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            lookup[int.from_bytes(t, "big")] = k + 1
        compiled = [(kind, re.compile(pattern, flags).finditer, accept) for kind, pattern, flags, accept in parts]
        for batch in pieces(batches, "text"):
            column = batch.column("text")
            segment = Segment(column, wanted, lookup)
            spans: list[list] = [[] for _ in range(len(batch))]
            for number, ((kind, finditer, accept), query) in enumerate(zip(compiled, queries, strict=True)):
                for row in segment.find(query).tolist():
                    spans[row] += [(m.start(), number, m.end(), kind) for m in finditer(column[row].as_py()) if accept(m)]
            out = [[{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(s)] for s in spans]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(out, _SPANS)})

    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, from `find_secrets`."""
    base = [r.kind for r in BASE_RULES]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, text))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
