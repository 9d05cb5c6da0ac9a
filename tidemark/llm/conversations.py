"""Conversation structure repair by a generalised LR parse of the roles, with weighted edits.

The roles of a sound conversation are a system turn, if any, and then pairs of a user's and an assistant's turn. An LR
automaton is made from that grammar. A row is read from every stack top that is alive: it is kept, given another role or
deleted, after any number of inserted turns, and each choice costs. Stacks share what lies below their tops (the
graph-structured stack); equal tops merge by the smaller (cost, audit), the audit being the initials of the edits so far.
Two audits that lead to different tops after the same row never begin one another, as each ends with the edit of that row.
Their order is therefore settled by the rows read, so that a top holds its cost and its rank among the others, not the text
of its audit, and a step from one set of tops is looked up after its first time. The audit is read off backwards at the end.

Rows are damaged, judged and marked as duplicates by Spark; a task parses a conversation's rows as they stream by, a few
bytes each and no texts, and a second pass streams the texts past the edits that were chosen. An edit list with one letter
a row and a hash over the whole text are one value of one row by contract, so a conversation of any length is one stream;
no task ever holds its texts.

Defined cases: a null role, text, conv_id or turn reads as one space, in what is hashed, too; rows of null conv_id are one
conversation and null turns come first. Rows of one turn stand in order of role and of their text's MD5; repeated rows
count each. A role that begins with none of s, u and a, or is empty, cannot be kept. A conversation without rows after
damage has zeros, an empty audit and the hash of an empty string. An empty table has no conversations. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.util import shuffle_width

# The grammar of roles by their initials, the costs of edits and the roles that edits may give.
GRAMMAR = (("sound", ""), ("sound", "turns"), ("turns", "u a"), ("turns", "s u a"), ("turns", "turns u a"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
GIVEN = {"u": "user", "a": "assistant"}
INITIALS = "sua"
CLEAN, DOOMED, CUT = 0, 1, 2
BLANKS = " \t\n\x0b\x0c\r"
DROP, EMPTY, UNSTOP, REPEAT, USER, OF = 0, 1, 2, 3, 4, 20


class Automaton:
    """The LR(0) automaton of a grammar: item sets, where symbols lead from them, and which productions end in them."""

    def __init__(self, grammar=GRAMMAR) -> None:
        self.rules = [("", ["sound"]), *((head, body.split()) for head, body in grammar)]
        first = self.closed({(0, 0)})
        self.sets, self.to = {first: 0}, {}
        self.done: list[list[int]] = []
        for items in (todo := [first]):
            here = self.sets[items]
            self.done.append([r for r, at in items if at == len(self.rules[r][1])])
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                onward = self.closed({(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == [symbol]})
                if onward not in self.sets:
                    self.sets[onward] = len(self.sets)
                    todo.append(onward)
                self.to[here, symbol] = self.sets[onward]

    def closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        for r, at in todo:
            for k, (head, _) in enumerate(self.rules):
                if self.rules[r][1][at : at + 1] == [head] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)


class Repair:
    """Stacks, the moves between them and the steps of a parse, each worked out once."""

    def __init__(self) -> None:
        self.lr = Automaton()
        self.nodes: list[tuple[int, int]] = [(0, -1)]  # a top's state and the node below it, shared by all stacks on it
        self.known = {(0, -1): 0}
        self.moves = cache(self.moves)
        self.endings = cache(self.endings)
        self.step = cache(self.step)

    def node(self, state: int, below: int) -> int:
        if (state, below) not in self.known:
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def reduced(self, top: int) -> Iterator[int]:
        """The stacks that the productions ending in top make of it, one step on."""
        for rule in self.lr.done[self.nodes[top][0]]:
            if rule:
                head, body = self.lr.rules[rule]
                under = top
                for _ in body:
                    under = self.nodes[under][1]
                yield self.node(self.lr.to[self.nodes[under][0], head], under)

    def all_reduced(self, top: int) -> list[int]:
        out = [top]
        for x in out:
            out += [y for y in self.reduced(x) if y not in out]
        return out

    def read(self, top: int, symbol: str) -> list[int]:
        """The tops after a role's initial. What can only be reduced is reduced at once, so that like stacks merge."""
        out = []
        for x in self.all_reduced(top):
            state = self.lr.to.get((self.nodes[x][0], symbol))
            if state is not None:
                new = self.node(state, x)
                while len(self.lr.done[self.nodes[new][0]]) == 1 and not any(s == self.nodes[new][0] for s, _ in self.lr.to):
                    new = next(self.reduced(new))
                out.append(new)
        return out

    def accepts(self, top: int) -> bool:
        return any(0 in self.lr.done[self.nodes[x][0]] for x in self.all_reduced(top))

    def inserted(self, top: int) -> dict[int, tuple[int, str]]:
        """Tops within reach by inserts alone, each with its cost and edits. An edit is written as its initial and the role's."""
        best, todo = {top: (0, "")}, [top]
        for x in todo:
            for role in GIVEN:
                for y in self.read(x, role):
                    if (new := (best[x][0] + INSERT, best[x][1] + "I" + role)) < best.get(y, (new[0] + 1,)):
                        best[y] = new
                        todo.append(y)
        return best

    def moves(self, top: int, token: int) -> dict[int, tuple[int, str]]:
        """Where a row of a kind leads from a top: the cheapest, then least edits for each top after it."""
        initial, fault = INITIALS[token // 3 : token // 3 + 1], token % 3
        best: dict[int, tuple[int, str]] = {}

        def offer(to: int, cost: int, edits: str) -> None:
            best[to] = min(best.get(to, (cost, edits)), (cost, edits))

        for x, (cost, edits) in self.inserted(top).items():
            offer(x, cost + DELETE, edits + "D-")
            if fault != DOOMED:
                cost += TRUNCATED * (fault == CUT)
                for y in self.read(x, initial) if initial else ():
                    offer(y, cost + KEEP, edits + "K-")
                for role in GIVEN:
                    for y in self.read(x, role):
                        offer(y, cost + REROLE, edits + "R" + role)
        return best

    def endings(self, top: int) -> tuple[int, str] | None:
        return min((way for x, way in self.inserted(top).items() if self.accepts(x)), default=None)

    def step(self, tops: tuple[tuple[int, int], ...], token: int):
        """tops: (node, cost over the least) in order of their audits. The same after a row, whence each came, and the least's rise."""
        best: dict[int, tuple[int, int, str]] = {}
        for rank, (x, cost) in enumerate(tops):
            for y, (more, edits) in self.moves(x, token).items():
                best[y] = min(best.get(y, (cost + more, rank, edits)), (cost + more, rank, edits))
        order = sorted(best, key=lambda y: best[y][1:])
        least = min(cost for cost, _, _ in best.values())
        return tuple((y, best[y][0] - least) for y in order), tuple(best[y][1:] for y in order), least

    def start(self) -> "Parse":
        return Parse(self)


class Parse:
    """One conversation's rows, in order."""

    def __init__(self, repair: Repair) -> None:
        self.repair, self.tops, self.cost, self.back = repair, ((0, 0),), 0, []

    def row(self, token: int) -> None:
        self.tops, back, rise = self.repair.step(self.tops, token)
        self.cost += rise
        self.back.append(back)

    def end(self) -> tuple[int, str]:
        """The least cost, and of its edits those whose initials come first, as pairs of initials of edit and role."""
        ways = [(cost + way[0], rank, way[1]) for rank, (x, cost) in enumerate(self.tops) if (way := self.repair.endings(x))]
        cost, rank, edits = min(ways)
        parts = [edits]
        for back in reversed(self.back):
            rank, edits = back[rank]
            parts.append(edits)
        return self.cost + cost, "".join(reversed(parts))


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and times: how often the row is there, 0 if it was dropped."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % OF
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == DROP, 0).when(F.col("kind") == REPEAT, 2).otherwise(1).alias("times"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Rows without their texts: token (kind of role and fault), and whether the same role and text stand in an earlier turn."""
    body = F.rtrim("text", F.lit(BLANKS))
    there = rows.select(
        "conv_id", "turn", "role", "times", F.unhex(F.md5("text")).alias("digest"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    key = ["conv_id", "role", "digest"]
    again = there.where("times > 0").groupBy(*key).agg(F.sum("times").alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
    again = again.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key], "first", "unnumbered")
    met = there.join(again, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first"))), F.lit(False))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    kind = F.when((F.col("role") == "") | (initial < 0), len(INITIALS)).otherwise(initial)
    return met.select("conv_id", "turn", "role", "digest", "times", kind.alias("initial"), "blank", "cut", later.alias("later"))


ORDER = ["turn", "role", "digest"]
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def streamed(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(shuffle_width(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def by_conversation(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each conversation's id and rows, which come together."""
    rows = (dict(zip(b.schema.names, row, strict=True)) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return ((key, group) for (_, key), group in groupby(rows, lambda r: (r["conv_id"] is None, r["conv_id"])))


def parsed(rows: DataFrame) -> DataFrame:
    """conv_id, the contract's figures, and edits, the chosen ones, of every conversation."""

    def run(batches):
        repair = Repair()
        for conv_id, group in by_conversation(batches):
            parse, counts = repair.start(), dict.fromkeys(FIGURES, 0)
            before = turn = None
            last = ()
            for r in group:
                for _ in range(r["times"]):
                    if r["turn"] is not None and r["turn"] != turn:
                        counts["gaps"] += r["turn"] - turn - 1 if turn is not None else 0
                        turn = r["turn"]
                    same = (r["turn"], r["role"], r["digest"])
                    fault = "blank" if r["blank"] else "duplicate" if r["later"] or same == last else "truncated" if r["cut"] else ""
                    counts["illegal"] += before is not None and (before, r["initial"]) not in ((0, 1), (1, 2), (2, 1))
                    if fault:
                        counts[fault] += 1
                    parse.row(3 * r["initial"] + (CUT if fault == "truncated" else DOOMED if fault else CLEAN))
                    before, last = r["initial"], same
            counts["cost"], edits = parse.end()
            yield conv_id, counts, edits

    return as_rows(streamed(judged(rows), *ORDER), run)


def as_rows(df: DataFrame, run) -> DataFrame:
    """run's rows (conv_id, figures, edits) by batches."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def batched(batches):
        at, held = 0, []
        for row in run(batches):
            held.append(row)
            at += len(row[2])
            if at > 1 << 20 or len(held) >= 10_000:
                yield batch(held)
                at, held = 0, []
        if held:
            yield batch(held)

    id_type = to_arrow_type(df.schema["conv_id"].dataType)

    def batch(held):
        cols = [pa.array([r[0] for r in held], id_type), *(pa.array([r[1][f] for r in held], pa.int64()) for f in FIGURES), pa.array([r[2] for r in held], pa.string()), pa.array([r[1].get("sha") for r in held], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["conv_id", *FIGURES, "edits", "repaired_sha256"])

    return df.mapInArrow(batched, ", ".join([f"conv_id {kind}", *[f"{f} bigint" for f in FIGURES], "edits string", "repaired_sha256 string"]))


def lines(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired conversation's role:text, given its edits and rows."""
    for action, role in zip(edits[::2], edits[1::2], strict=True):
        if action == "I":
            yield f"{GIVEN[role]}:"
            continue
        own, text = next(rows)
        if action != "D":
            yield f"{own if action == 'K' else GIVEN[role]}:{text}"


def repair(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text): one row for each conv_id, as the contract has it, and edits."""
    rows = damaged(conversations)
    found = parsed(rows).select("conv_id", *FIGURES, "edits", F.lit(0).alias("kind"))
    texts = rows.where("times > 0").select("conv_id", "turn", "role", "text", "times", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("kind"))
    both = found.unionByName(texts, allowMissingColumns=True)

    def run(batches):
        for conv_id, group in by_conversation(batches):
            head = next(group)
            sha, first = hashlib.sha256(), True
            for line in lines(head["edits"], ((r["role"], r["text"]) for r in group for _ in range(r["times"]))):
                sha.update(line.encode() if first else b"\n" + line.encode())
                first = False
            yield conv_id, head | {"sha": sha.hexdigest()}, head["edits"]

    done = as_rows(streamed(both, "kind", *ORDER), run)
    audit = F.regexp_replace("edits", "(.).", "$1")
    return done.select("conv_id", *FIGURES, audit.alias("audit"), "repaired_sha256", "edits")
