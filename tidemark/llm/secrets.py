"""Secret scans: all rules compiled into one minimal deterministic automaton over bytes.

The rules' regexes become one NFA; subset construction and partition refinement turn it into a transition table
whose states say which rules have a match ending there. One pass over the bytes of a text then finds the ends for
every rule at once; each end's start comes from the rule's reversed automaton, which reads the match backwards only.

Defined cases: null text counts as empty and has no spans. A rule's matches are leftmost, longest and do not overlap;
matches of different rules may. Neighbouring ends are read as one match that goes on, so a rule's pattern must end in a
repeated class, or in characters that end no other match beside it. An added rule's last run is its tail: the automaton
finds where it begins, and the match goes on through the tail's class, so that open runs of many rules do not multiply
the states. A match that fails its length test is dropped but still consumes its text. Offsets are code points, the end
exclusive. Null doc_id and repeated rows are kept as they are. A text of any length is
scanned whole.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import unused


class Rule(NamedTuple):
    kind: str
    pattern: str
    keep: str | None = None
    """A found match is dropped unless this pattern matches the whole of it."""
    tail: str = ""
    """A class of ASCII characters through which a match goes on after the pattern's end."""


# The rules to match; the first three are the base ones.
RULES = (
    Rule(
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        r"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"[A-Z0-9]{18,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r".{40,}", "[A-Za-z0-9]"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]", r".{39,}", "[A-Za-z0-9_-]"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]", r".{24,}", "[A-Za-z0-9-]"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]", r".{24,}", "[A-Za-z0-9]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", r".{40,}", "[A-Za-z0-9_-]"),
)
BASE = 3


class Parser:
    """Rules' patterns as nested lists: ("in", bytes), ("any", branches), ("repeat", least, most or None, branches). A branch is a list of these.

    Known are letters that stand for themselves, escapes, classes of ASCII characters and ranges, groups, branches and the
    counts ?, *, +, {n}, {n,} and {n,m}.
    """

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"not supported in a rule: \\{c}")
        return ord(c)

    def branches(self) -> list[list]:
        out: list[list] = [[]]
        while self.peek() not in ("", ")"):
            if self.peek() == "|":
                self.take()
                out.append([])
            else:
                out[-1].append(self.counted(self.item()))
        return out

    def item(self) -> tuple:
        if self.peek() == "(":
            self.take()
            inner = self.branches()
            self.take()
            return ("any", inner)
        if self.peek() == "[":
            self.take()
            members: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    members |= set(range(low, self.char() + 1))
                else:
                    members.add(low)
            self.take()
            return ("in", frozenset(members))
        if self.peek() in ".^$*+?{":
            raise ValueError(f"not supported in a rule: {self.peek()}")
        return ("in", frozenset([self.char()]))

    def counted(self, item: tuple) -> tuple:
        known = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        if self.peek() in known and self.peek():
            return ("repeat", *known[self.take()], [[item]])
        if self.peek() != "{":
            return item
        low, comma, high = self.pattern[self.at + 1 : self.pattern.index("}", self.at)].partition(",")
        self.at = self.pattern.index("}", self.at) + 1
        return ("repeat", int(low), int(high) if high else None if comma else int(low), [[item]])


class Nfa:
    """Thompson's construction; edges[s] holds (bytes, target), free[s] the targets that take no byte."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def build(self, items: list[tuple], at: int, backwards: bool) -> int:
        """Add a branch that begins in state at; returns the state in which it ends."""
        for kind, *arg in reversed(items) if backwards else items:
            if kind == "in":
                at = self.step(at, arg[0])
            elif kind == "any":
                at = self.choice(arg[0], at, backwards)
            else:
                at = self.repeat(*arg, at, backwards)
        return at

    def choice(self, branches: list[list], at: int, backwards: bool) -> int:
        ends, out = [self.build(x, at, backwards) for x in branches], self.state()
        for end in ends:
            self.free[end].append(out)
        return out

    def step(self, at: int, on: frozenset[int]) -> int:
        self.edges[at].append((on, to := self.state()))
        return to

    def repeat(self, least: int, most: int | None, body: list[list], at: int, backwards: bool) -> int:
        for _ in range(least):
            at = self.choice(body, at, backwards)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.choice(body, loop, backwards)].append(loop)
            return loop
        out = self.state()
        for _ in range(most - least):
            self.free[at].append(out)
            at = self.choice(body, at, backwards)
        self.free[at].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def compile_table(patterns, anchored: bool, backwards: bool) -> list[list[int]]:
    """Rows of a minimal automaton: 256 next states, then the bit set of the patterns that match up to here."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for i, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[start].append(first)
        ends[nfa.choice(Parser(pattern).branches(), first, backwards)] = 1 << i
    begin = nfa.closure([start])
    ids, todo, rows = {begin: 0}, [begin], []
    for states in todo:
        to: list[set[int]] = [set() if anchored else {start} for _ in range(256)]
        for s in states:
            for on, target in nfa.edges[s]:
                for b in on:
                    to[b].add(target)
        known: dict[frozenset[int], int] = {}
        row = []
        for b in range(256):
            key = frozenset(to[b])
            if key not in known:
                closed = nfa.closure(key)
                if closed not in ids:
                    ids[closed] = len(ids)
                    todo.append(closed)
                known[key] = ids[closed]
            row.append(known[key])
        rows.append([*row, sum(ends.get(s, 0) for s in states)])
    return minimise(rows)


def minimise(rows: list[list[int]]) -> list[list[int]]:
    """Split states by accepted patterns, then by where their bytes lead, until no class splits any more."""
    part = [row[256] for row in rows]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[i], *(part[t] for t in row[:256])), len(seen)) for i, row in enumerate(rows)]
        if len(seen) == len(set(part)):
            break
        part = new
    ids: dict[int, int] = {}
    for i in range(len(rows)):  # the begin state stays 0
        ids.setdefault(part[i], len(ids))
    out: list[list[int]] = [[] for _ in ids]
    for i, row in enumerate(rows):
        out[ids[part[i]]] = [*(ids[part[t]] for t in row[:256]), row[256]]
    return out


def linked(rows: list[list[int]]) -> list[list]:
    """The same table with each next state given as its row, so that a step is one list access. A state that leads nowhere is empty."""
    made: list[list] = [[] for _ in rows]
    for row, new in zip(rows, made, strict=True):
        new.extend(made[t] for t in row[:256])
        new.append(row[256])
    for k, row in enumerate(rows):
        if not row[256] and set(row[:256]) == {k}:
            made[k].clear()
    return made


@cache
def tables(rules: tuple[Rule, ...]) -> list[np.ndarray]:
    """The transition array of all rules together, then each rule's own one for reading backwards: made once, on the driver."""
    rows = [compile_table([r.pattern for r in rules], False, False), *(compile_table([r.pattern], True, True) for r in rules)]
    return [np.array(table, np.uint16) for table in rows]


READY: dict[tuple[Rule, ...], tuple] = {}


def ready(rules: tuple[Rule, ...], shipped: list[np.ndarray] | None = None) -> tuple:
    """What find needs of the rules, linked once in a process, from the arrays that came with the task if any did."""
    if rules not in READY:
        ahead, *back = [linked(table.tolist()) for table in shipped or tables(rules)]
        READY[rules] = ahead, back, [re.compile(r.keep.encode()) if r.keep else None for r in rules], [re.compile(r.tail.encode() + b"*") if r.tail else None for r in rules]
    return READY[rules]


def find(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, ordered."""
    ahead, back, keep, tail = ready(rules)
    row, ends = ahead[0], []
    for i, b in enumerate(data):
        row = row[b]
        if row[256]:
            ends.append((i, row[256]))
    found = []
    for k in range(len(rules) if ends else 0):
        places = [i for i, on in ends if on >> k & 1]
        after = 0
        for i, following in zip(places, [*places[1:], -1]):  # noqa: B905
            if following == i + 1:
                continue  # the match goes on
            row, start = back[k][0], -1
            for at in range(i, after - 1, -1):
                row = row[data[at]]
                if not row:
                    break
                if row[256]:
                    start = at
            if start >= 0:
                after = tail[k].match(data, i + 1).end() if tail[k] else i + 1
                if not keep[k] or keep[k].fullmatch(data, start, after):
                    found.append((start, k, after))
    return sorted(found)


def code_points(data: bytes, found: list[tuple[int, int, int]]) -> dict[int, int]:
    """How many code points lie before each bound of found, in one walk over data."""
    out, at, n = {}, 0, 0
    for place in sorted({p for start, _, end in found for p in (start, end)}):
        n += len(data[at:place].decode())
        out[place] = n
        at = place
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs, and found: ARRAY<STRUCT<kind, start, stop>> in code points, by start, then rule. Narrow: no shuffle.

    Where docs has a column of that name the new one has underscores after it.
    """
    name = unused(docs, "found")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    shipped = tables(rules)

    def run(batches):
        ready(rules, shipped)
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")):
                found = find(data := (text.as_py() or "").encode(), rules)
                place = code_points(data, found)
                out.append([{"kind": rules[k].kind, "start": place[s], "stop": place[e]} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, spans)], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.expr("CAST(NULL AS ARRAY<STRUCT<kind: STRING, start: BIGINT, stop: BIGINT>>)")).schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    base = F.filter("found", lambda x: x["kind"].isin(*[r.kind for r in RULES[:BASE]]))
    said = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(r.kind) for r in RULES[:BASE]],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark; overlapping spans become one mark. n_chars, if there, is counted anew.

    Texts without a secret, null ones too, are kept as they are.
    """
    shipped = tables(RULES)

    def run(batches):
        ready(RULES, shipped)
        for batch in batches:
            texts = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                spans = find(data := text.encode()) if text else []
                if spans:
                    out, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            out += [data[at:start], mark.encode()]
                        at = max(at, end)
                    text = b"".join([*out, data[at:]]).decode()
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
