"""Secret scans: each rule's regex gives a Boolean query over trigrams, which picks the texts to match it on.

Every batch of documents is a shard of the index: postings of the trigrams that any
query names are made for the batch, the queries intersect and unite them, and only the
texts that remain are matched. A rule of which no trigram is mandatory is matched on all
texts. The result doesn't depend on how documents are dealt out, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _parser as parser  # the standard library's own parse trees


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least``: characters that ``group`` of a match must have, else it's dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


#: The kinds that a result always has.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Published formats of other credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (any text), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
_MOST_STRINGS = 24


def _and(*queries: Query) -> Query:
    parts = [p for q in queries if q is not None for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))]
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(queries: list[Query]) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    parts = list(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str) -> Query:
    return _and(*(s[i : i + 3] for i in range(len(s) - 2)))


def trigram_query(pattern: str, any_case: bool = False) -> Query:
    """What any text that the pattern matches must have, over trigrams in lower case.

    A part of the pattern has either a small set of strings, one of which it must be, or
    just a query. In a sequence, sets are joined into longer strings for as long as they
    are small; a part of the other kind ends the run, whose strings' trigrams are then
    asked for. The flag is not needed, since everything is looked up in lower case.
    """

    def sets(tree) -> tuple[set[str] | None, Query]:
        run, query = {""}, None
        whole = True
        for op, arg in tree:
            strings, more = node(op, arg)
            joined = {a + b for a in run for b in strings} if strings is not None else None
            if joined is not None and len(joined) <= _MOST_STRINGS:
                run = joined
                query = _and(query, more)
                continue
            query = _and(query, _or([_of_string(s) for s in run]), more)
            whole, run = False, strings if strings is not None else {""}
        if whole:
            return run, query
        return None, _and(query, _or([_of_string(s) for s in run]))

    def full(tree) -> Query:
        strings, query = sets(tree)
        return query if strings is None else _and(query, _or([_of_string(s) for s in strings]))

    def node(op, arg) -> tuple[set[str] | None, Query]:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, None
        if name == "IN":
            chars: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < _MOST_STRINGS:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 6 else (None, None)
        if name == "SUBPATTERN":
            return sets(arg[-1])
        if name == "BRANCH":
            each = [sets(x) for x in arg[1]]
            if all(s is not None for s, _ in each) and len(union := set().union(*(s for s, _ in each))) <= _MOST_STRINGS:
                return union, _or([q for _, q in each])
            return None, _or([full(x) for x in arg[1]])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, tree = arg
            strings, query = sets(tree)
            if (low, high) == (1, 1):
                return strings, query
            if (low, high) == (0, 1) and strings is not None:
                return strings | {""}, None
            return None, full(tree) if low else None
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}, None
        return None, None

    return full(parser.parse(pattern))


def _named(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


class Scanner:
    """Compiled rules and their queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | re.IGNORECASE if r.any_case else re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(_named(q) for _, _, q in self.rules)))
        self.automaton = ahocorasick.Automaton()
        for g in self.trigrams:
            self.automaton.add_word(g, g)
        self.automaton.make_automaton()

    def postings(self, texts: list[str]) -> dict[str, set[int]]:
        """The index of a shard: for each trigram that a query names, the rows that have it; each text is read once."""
        found: dict[str, set[int]] = {g: set() for g in self.trigrams}
        for i, t in enumerate(texts):
            for g in {g for _, g in self.automaton.iter(t.lower())} if self.trigrams else ():
                found[g].add(i)
        return found

    def candidates(self, texts: list[str]) -> list[set[int] | range]:
        """By rule, the rows of a shard that its query leaves."""
        postings = self.postings(texts)

        def rows(query: Query) -> set[int]:
            if isinstance(query, str):
                return postings[query]
            found = [rows(q) for q in query[1]]
            return set.intersection(*sorted(found, key=len)) if query[0] == "and" else set().union(*found)

        return [range(len(texts)) if q is None else rows(q) for _, _, q in self.rules]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """By text, (start, rule's number, end) of what is found, in order; positions are code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, ((rule, pattern, _), at) in enumerate(zip(self.rules, self.candidates(texts), strict=True)):
            for i in at:
                for m in pattern.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, shard_rows: int = 512
) -> DataFrame:
    """One row per input row: ``doc_id, found array<struct<kind, start, end>>``.

    Matches of a rule are leftmost and do not overlap; those whose group is too short are
    dropped. Spans are whole matches, by start and then in the rules' order, in code points,
    the end exclusive. A null or empty text has none. Texts of any length are scanned whole.
    Repeated rows give repeated results; an empty table gives an empty one; other columns
    are not looked at.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for b in batches:
            for part in (b.slice(i, shard_rows) for i in range(0, b.num_rows, shard_rows)):
                found = [[{"kind": rules[n].kind, "start": a, "end": e} for a, n, e in spans] for spans in scanner.scan(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, span)], ["doc_id", "found"])

    return source.mapInArrow(apply, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of the rows of :func:`secret_scan`."""
    base = [r.kind for r in BASE_RULES]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only_base = F.filter("found", lambda s: s["kind"].isin(base))
    return scanned.select("doc_id", *map(count, base), F.sha2(text(only_base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
