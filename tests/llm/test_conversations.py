"""Conversation operators against SQL and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lavrado.llm import conversation_repair, conversation_trie
from lavrado.llm.queries import oracle_sql, queries

from . import cases

SCHEMA = "conv_id long, turn long, role string, text string, digest string, place long, gone boolean"


def odd_rows() -> list[tuple]:
    """Conversations with nulls, ties, repeats, gaps, long texts and columns of names that the operators use."""
    draw = random.Random(3)
    rows = []
    for conv in [*range(-7, 60), 2**40, None]:
        for turn in range(draw.randrange(0, 9)):
            text = draw.choice(["Hello there.", "Why?", "no end", " \t", "", None, "Ja! ", "été.\n", f"{draw.randrange(9)}. word", "a\x00.", "z" * 50 + "?"])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "élan", "umbra"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), role, text, "d", 7, True))
        if rows and draw.random() < 0.3:
            rows.append(rows[-1])
    rows += [(500, k, "user" if k % 2 == 0 else "assistant", "x " * 200_000 + f"{k}.", None, None, None) for k in range(4)]
    rows += [(501, k, ("user", "assistant")[k % 2], f"turn {k}.", None, None, None) for k in range(700)]
    return rows + [(k, 0, "user", "Alone.", None, None, None) for k in range(600, 800)]  # some lose their only turn


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def numbers(rows: list[tuple]) -> dict:
    """conv_id: [(turn, role, text)] in order, nulls as one space, equal turn numbers by role and digest of the text."""
    found: dict = {}
    for conv, turn, role, text in (r[:4] for r in rows):
        found.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16])) for k, v in found.items()}


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in (r[:4] for r in rows):
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        by = zlib.crc32(key.encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", " " if text is None else text) if by == 2 else text
        out += [(conv, turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    return out


def brute(turns: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by a search over all cheapest ways, as whole strings."""
    known, seen, faults = [t for t, _, _ in turns if t is not None], set(), []
    for _, role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way
            cost, audit, out = way
            for x in follow[state]:
                if x in names:
                    put(to, x, (cost + 5, audit + "I", (*out, names[x] + ":")))

    first: dict = {}
    put(first, "", ways[""])
    ways = first
    for (_, role, text), fault in zip(turns, faults):
        to: dict = {}
        for state, (cost, audit, out) in ways.items():
            put(to, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for x in follow[state]:
                    if role[:1] == x:
                        put(to, x, (cost + more, audit + "K", (*out, f"{role}:{text}")))
                    if x in names:
                        put(to, x, (cost + more + 1, audit + "R", (*out, f"{names[x]}:{text}")))
        ways = to
    cost, audit, out = min(ways[x] for x in ("", "a") if x in ways)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_conversation_trie"])
def test_against_sql(spark, sf_dir, name):
    got, con = queries()[name](spark, sf_dir), duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.sql(oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert cases.table(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_repair_of_odd_rows(spark):
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.reports(frame(spark)).collect()}
    assert got == {k: brute(v) for k, v in numbers(odd_rows()).items()}
    assert conversation_repair.reports(frame(spark, [])).count() == 0


def test_repair_of_damaged_rows(spark):
    """The query's damage, conversations that lose all their turns included."""
    rows = [r for r in odd_rows() if r[0] != 500]
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.reports(conversation_repair.damaged(frame(spark, rows)), absent=F.col("absent")).collect()}
    left = numbers(damage(rows))
    assert got == {k: brute(left.get(k, [])) for k in {r[0] for r in rows}}
    assert any(k not in left for k in got)


def test_repaired_turns_are_right(spark):
    rows: dict = {}
    for r in conversation_repair.repaired(frame(spark)).collect():
        rows.setdefault(r.conv_id, []).append(r)
    want = {k: brute(v) for k, v in numbers(odd_rows()).items()}
    for k, w in want.items():
        some = sorted(rows.get(k, []), key=lambda r: r.place)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in some))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in some).encode()).hexdigest() == w[-1]
        assert "".join(r.edit for r in some) == w[-2].replace("D", "")


def test_every_short_conversation_is_repaired_at_least_cost():
    """All sequences of up to five symbols, by the table, against the search over strings."""
    repairs = conversation_repair.Repairs()
    kinds = [(0, "user", ""), *[(1 + 2 * k + t, role, "x." if not t else "x") for k, role in enumerate(("system", "user", "assistant", "tool")) for t in (0, 1)]]
    for n in range(5):
        for some in itertools.product(kinds, repeat=n):
            turns = [(k, role, text and f"{k}{text}") for k, (_, role, text) in enumerate(some)]
            states, cost = repairs.scanned(bytes(s for s, _, _ in some))
            q, audit = 0, ""
            for k, (s, _, _) in enumerate(some):
                more, _, _, _, q = repairs.step(states[k + 1], s, q)
                audit += more
            audit += "I" * len(repairs.end(q))
            assert (cost, audit) == brute(turns)[5:7]
    assert len(repairs.vectors) < 64


def strings(rows: list[tuple], rebuilt: bool) -> dict[int, list[tuple[str, str]]]:
    """conv_id: [(role, text)] in order, nulls empty, equal turn numbers by digest."""
    found: dict = {}
    for conv, turn, role, text in (r[:4] for r in rows):
        if conv is not None:
            role, text = role or "", text or ""
            found.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {k: [x[3:] for x in sorted(v)] for k, v in found.items()}
    if not rebuilt:
        return own
    first = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    n = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(first(c), [])[: n[c]] + own[c][n[c] :] for c in own}


def nodes(whole: dict[int, list]) -> list[tuple]:
    """All nodes by their prefixes, children and subtrees by comparing prefixes."""
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below: dict = {}
    for p in members:
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    inner = {p[:-1] for p in members if p}
    children: dict = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    out = []
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(whole[c]) == len(p))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[p] if x)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children.get(p, 0), sum(x not in inner for x in below[p]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def crowd() -> list[tuple]:
    """Hundreds of copies of a conversation, of its start and of its continuation, and some without turns in common."""
    rows = [(k, t, ("user", "assistant")[t % 2], f"common {t}", None, None, None) for k in range(1000, 1400) for t in range(3 + k % 3)]
    return rows + [(k, t, "user", f"own {k} {t}", None, None, None) for k in range(2000, 2050) for t in range(1 + k % 2)] + [(3000 + k, t, "user", f"long {t}", None, None, None) for k in range(2) for t in range(400 + k)]


@pytest.mark.parametrize("rebuilt", [False, True])
@pytest.mark.parametrize("size", [conversation_trie.RANGE_BYTES, 2000])
def test_trie_of_odd_rows(spark, rebuilt, size):
    """With strings dealt out over few and over many ranges, so that copies and paths cross them."""
    rows = odd_rows() + crowd()
    df = frame(spark, rows)
    by = {"family": F.col("conv_id") - F.col("conv_id") % 5, "head": conversation_trie.rebuilt_head} if rebuilt else {}
    got = conversation_trie.trie(conversation_trie.strings(df, **by), range_bytes=size)
    assert cases.table(got) == nodes(strings(rows, rebuilt))


def test_trie_of_no_rows_and_of_empty_conversations(spark):
    assert conversation_trie.conversation_trie(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(5, b""), (3, b"")], "conv_id long, turns binary")
    assert [tuple(r) for r in conversation_trie.trie(rows).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_node_turns(spark):
    df = frame(spark)
    whole = strings(odd_rows(), False)
    for r in conversation_trie.node_turns(conversation_trie.conversation_trie(df), df).collect():
        assert (r.role, r.text) == (whole[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_loser_tree_merges_and_tells_shared_turns():
    draw = random.Random(1)
    for n in range(40):
        rows = [(b"".join(draw.choice((b"a", b"b")) * conversation_trie.TURN for _ in range(draw.randrange(7))), k) for k in range(draw.randrange(60))]
        cut = draw.randrange(1, 12)
        runs = [conversation_trie.Run(rows[k::cut]) for k in range(cut)]
        got = list(conversation_trie.merged(runs))
        assert [r[:2] for r in got] == sorted(rows)
        before = b""
        for turns, _, lcp in got:
            assert lcp == conversation_trie.shared_turns(before, turns)
            before = turns
