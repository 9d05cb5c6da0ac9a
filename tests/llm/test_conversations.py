"""Conversation repair against a search over all edit strings, and against a plain automaton on generated and given rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, oracles, queries

TYPE = "conv_id bigint, turn bigint, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, texts) over (role, text, fault) rows: every state's best by (cost, audit), as whole strings."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for q, (c, w, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = NEXT.get((q, role[0]))
                    if to and (c + 3, w + "I") < best.get(to, (10**9, ""))[:2]:
                        best[to] = (c + 3, w + "I", (*out, f"{role}:"))
        return best

    for role, text, fault in rows:
        new = {}

        def offer(to, c, w, out):
            if to is not None and (c, w) < new.get(to, (10**9, ""))[:2]:
                new[to] = (c, w, out)

        for q, (c, w, out) in insert(dict(best)).items():
            offer(q, c + 4, w + "D", out)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                offer(NEXT.get((q, role[:1])), c + extra, w + "K", (*out, f"{role}:{text}"))
                for r in ("user", "assistant"):
                    offer(NEXT.get((q, r[0])), c + 3 + extra, w + "R", (*out, f"{r}:{text}"))
        best = new
    return min(v for q, v in insert(dict(best)).items() if q in ("", "a"))


def exhaustive(rows):
    """The same by trying every edit string in order of length up to a bound on its cost."""
    bound, found = cheapest(rows)[0], []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if 3 * sum(inserts) > bound:
            continue
        for acts in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and a != "D" for (_, _, f), a in zip(rows, acts, strict=True)):
                continue
            cost = 3 * sum(inserts) + sum({"D": 4, "K": 0, "R": 3}[a] + 3 * (a != "D" and f == "truncated") for (_, _, f), a in zip(rows, acts, strict=True))
            audit = "".join("I" * n + a for n, a in itertools.zip_longest(inserts, acts, fillvalue=""))
            if cost > bound:
                continue
            q, k = "", 0
            for x in audit:
                role = rows[k][0][:1] if x in "DKR" else ""
                k += x in "DKR"
                if x == "D":
                    continue
                q = NEXT.get((q, role)) if x == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}.get(q)
                if q is None:
                    break
            if q in ("", "a"):
                found.append((cost, audit))
    return min(found)


def brute(table):
    groups = collections.defaultdict(list)
    say = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        n = collections.Counter(f for _, _, f in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, texts = cheapest(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def found(df):
    got = df.collect()
    assert df.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:9] for r in got}


def test_parse_against_all_edit_strings():
    rng, repair = random.Random(4), conversations.Repair()
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        parse = repair.start()
        for role, _, fault in rows:
            kind = "sua".find(role[0]) if role else -1
            parse.row(3 * (kind if kind >= 0 else 3) + {"": 0, "truncated": 2}.get(fault, 1))
        cost, edits = parse.end()
        assert (cost, edits[::2]) == cheapest(rows)[:2] == exhaustive(rows), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in conversations.lines(edits, iter([(r, t) for r, t, _ in rows]))))


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rng = random.Random(seed)
    table = []
    for conv in range(400):
        roles = rng.choices(["system", "user", "assistant", "user", "assistant", "tool", "", None], k=rng.randint(1, 9)) if conv % 2 else ["system", "user", "assistant", "user", "assistant"][: rng.randint(1, 5)]
        table += [(conv, rng.choice([k, k, k, 2 * k, None]), r, rng.choice(["Yes.", "No!", "And so on", " \t", "", None, "é?\x0b", f"Turn {k}."])) for k, r in enumerate(roles)]
    table += [(None, k, "user", "x.") for k in range(6)] + [(None, None, "assistant", None)] * 3 + [(1000, 5, "user", "a b.")] * 9
    table += [(2000, k, ("user", "assistant")[k % 2], f"{'long ' * 2000}{k}.") for k in range(300)]
    df = spark.createDataFrame(table, TYPE).repartition(5)
    assert found(conversations.repair(df)) == brute(table)
    named = df.select("*", *[F.lit("x").alias(c) for c in ("times", "kind", "digest", "edits", "first", "blank")])
    assert found(conversations.repair(named)) == brute(table)


def test_one_long_conversation(spark):
    rng = random.Random(9)
    table = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {k}.", f"Turn {k}"])) for k in range(30_000)]
    assert found(conversations.repair(spark.createDataFrame(table, TYPE))) == brute(table)


def test_empty_dropped_and_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert conversations.repair(df.limit(0)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert found(conversations.repair(spark.createDataFrame([(dropped, 0, "user", "x")], TYPE))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    named = spark.createDataFrame([("é", 1, "user", "Hi."), ("é", 2, "assistant", "Yes.")], TYPE.replace("conv_id bigint", "conv_id string"))
    assert found(conversations.repair(named)) == brute([("é", 1, "user", "Hi."), ("é", 2, "assistant", "Yes.")])
    table = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversations(spark, sf)) == brute(table)


def test_sql_of_the_contract(sf):
    folder = sf.replace("0.001", "0.01")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = {r[0]: tuple(r[1:]) for r in duck.sql(oracles.CONVERSATIONS).fetchall()}
    assert got == brute(duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
