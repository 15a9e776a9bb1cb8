"""Conversation structure repair by lazy weighted determinisation.

A conversation is right if its roles' initials are `(s?(ua)+)?` and no turn is blank or a repeat.  Edits: Keep (0),
Rerole to user or assistant (1), Delete (2, the only edit of blank and repeated turns), Insert an empty user or
assistant turn anywhere (5); a truncated turn that isn't deleted adds 5.  The cheapest edits are wanted, and of equally
cheap ones those whose initials come first in ASCII order.

Automaton: for each state of the grammar, the cost of finishing from there is a vector; less its least entry, it is one
state of a deterministic automaton.  Reading turns from the last to the first, (state, symbol) leads to a state and an
amount to add; each pair is worked out when it is first met and kept in a table that all conversations of a Python
worker share.  A conversation's cost is a scan of that table.  Going back over the scan (so from the first turn to the
last), an arc is tight if its cost and the vector behind it add up to the vector before it; the least initial among
tight arcs, kept in a table too, gives the audit.

Plan: one shuffle by conversation.  Each turn is sent twice, without its text and with it, and sorted so that all
turns without text come first: they give costs and edits, then texts stream through the edits.  What a task holds of
a conversation is about 100 bytes a turn (the digests that tell repeats, most of all), never its texts; a conversation
isn't split, as its audit is one string and its SHA-256 has to be taken in order.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, functions as F

from .shared import small_batches, table, utf8

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or renamed turn has, and the state after it.
GIVEN = {START: (b"user", USER), SYSTEM: (b"user", USER), USER: (b"assistant", ASSISTANT), ASSISTANT: (b"user", USER)}
LEGAL = {b"su", b"ua", b"au"}
_FAR = 1 << 40
#: Symbols: 0 must be deleted; else 1 + 2 * place of the initial + 1 if truncated.
INITIALS = "sua"
SYMBOLS = 1 + 2 * (len(INITIALS) + 1)
#: White space of turns.
BLANK = " \t\n\x0b\x0c\r"


class Repairs:
    """The automaton, as far as it has been asked for."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.to: list[int] = []
        self.add: list[int] = []
        self.steps: dict[tuple[int, int, int], tuple] = {}
        self.last = self._state(self._closed([0, _FAR, _FAR, 0]))

    def _state(self, vector: list[int]) -> int:
        v = tuple(vector)
        if v not in self.known:
            self.known[v] = len(self.vectors)
            self.vectors.append(v)
            self.to += [-1] * SYMBOLS
            self.add += [0] * SYMBOLS
        return self.known[v]

    @staticmethod
    def _closed(v: list[int]) -> list[int]:
        """Inserted turns: user and assistant follow each other, so two rounds are enough."""
        for _ in range(2):
            for q in (USER, ASSISTANT, SYSTEM, START):
                v[q] = min(v[q], INSERT + v[GIVEN[q][1]])
        return v

    @staticmethod
    def _arcs(q: int, symbol: int) -> Iterator[tuple[str, int, int, bytes | None]]:
        """(edit, cost, next state, new role) of a turn in state q, in the edits' order."""
        yield "D", DELETE, q, None
        if symbol:
            initial, more = INITIALS[(symbol - 1) // 2 : (symbol + 1) // 2], (symbol - 1) % 2 * TRUNCATED
            if (q, initial) in NEXT:
                yield "K", KEEP + more, NEXT[q, initial], None
            yield "R", REROLE + more, GIVEN[q][1], GIVEN[q][0]

    def _met(self, state: int, symbol: int) -> None:
        v = self.vectors[state]
        found = self._closed([min(cost + v[to] for _, cost, to, _ in self._arcs(q, symbol)) for q in range(4)])
        least = min(found)
        at = state * SYMBOLS + symbol
        to = self._state([x - least for x in found])
        self.to[at], self.add[at] = to, least

    def scanned(self, symbols: bytes) -> tuple[array, int]:
        """The automaton's state before each turn and after the last one, and the cheapest cost."""
        state, total, n = self.last, 0, len(symbols)
        states = array("I", bytes(4 * (n + 1)))
        states[n] = state
        to, add = self.to, self.add
        for k in range(n - 1, -1, -1):
            at = state * SYMBOLS + symbols[k]
            if to[at] < 0:
                self._met(state, symbols[k])
            state = to[at]
            total += add[at]
            states[k] = state
        return states, total + self.vectors[state][START]

    def step(self, after: int, symbol: int, q: int) -> tuple[str, tuple[bytes, ...], str, bytes | None, int]:
        """What happens at a turn in state q if the automaton is in `after` behind it: (audit, inserted roles, edit, new role, next state)."""
        key = (after, symbol, q)
        if key not in self.steps:
            if self.to[at := after * SYMBOLS + symbol] < 0:
                self._met(after, symbol)
            v, w, more = self.vectors[self.to[at]], self.vectors[after], self.add[at]
            audit, inserted = "", []
            while True:
                tight = [a for a in self._arcs(q, symbol) if v[q] + more == a[1] + w[a[2]]]
                if v[q] == INSERT + v[GIVEN[q][1]]:
                    tight.append(("I", INSERT, GIVEN[q][1], GIVEN[q][0]))
                edit, _, q, role = min(tight, key=itemgetter(0))
                audit += edit
                if edit != "I":
                    break
                inserted.append(role)
            self.steps[key] = audit, tuple(inserted), edit, role, q
        return self.steps[key]

    def end(self, q: int) -> tuple[bytes, ...]:
        """Roles that are inserted after the last turn."""
        out = []
        while self.vectors[self.last][q]:
            role, q = GIVEN[q]
            out.append(role)
        return tuple(out)


def _turns(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        b = {k: batch.column(k) for k in batch.schema.names}
        yield from zip(b["conv_id"].to_pylist(), b["pass"].to_pylist(), b["turn"].to_pylist(), utf8(b["role"]), b["digest"].to_pylist(), b["fault"].to_pylist(), utf8(b["text"]))


class Conversation:
    """The faults, the cost and the edits of one conversation's turns, which come without their texts."""

    def __init__(self, repairs: Repairs, turns: Iterator[tuple]) -> None:
        symbols, seen, before = bytearray(), set(), None
        least = most = None
        self.n = dict.fromkeys(("distinct", "blank", "duplicate", "truncated", "illegal"), 0)
        for _, _, turn, role, digest, fault, _ in turns:
            if turn is not None and turn != most:
                self.n["distinct"] += 1
                least, most = turn if least is None else least, turn
            initial = role.decode()[:1]
            if before is not None:
                self.n["illegal"] += (before + initial).encode() not in LEGAL
            before = initial
            key = digest + role
            if fault != "blank" and key in seen:
                fault = "duplicate"
            seen.add(key)
            if fault:
                self.n[fault] += 1
            place = INITIALS.find(initial) if initial else -1
            symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * (place if place >= 0 else len(INITIALS)) + (fault == "truncated"))
        self.gaps = 0 if least is None else most - least + 1 - self.n["distinct"]
        self.repairs, self.symbols = repairs, bytes(symbols)
        self.states, self.cost = repairs.scanned(self.symbols)
        self.audit: list[str] = []

    def repaired(self, turns: Iterator[tuple]) -> Iterator[tuple]:
        """(edit, turn, role, text) of what is kept or inserted, in order; turns come with their texts."""
        q = START
        for k, (_, _, turn, role, _, _, text) in enumerate(turns):
            audit, inserted, edit, given, q = self.repairs.step(self.states[k + 1], self.symbols[k], q)
            self.audit.append(audit)
            for r in inserted:
                yield "I", None, r, b""
            if edit != "D":
                yield edit, turn, given or role, text
        for r in self.repairs.end(q):
            self.audit.append("I")
            yield "I", None, r, b""


def _each(batches: Iterator) -> Iterator[tuple]:
    """(conv_id, Conversation, its repaired turns) one after the other; a conversation's turns have to be used up before the next."""
    repairs = Repairs()
    for conv, rows in groupby(_turns(batches), key=itemgetter(0)):
        passes = groupby(rows, key=itemgetter(1))
        k, part = next(passes)
        if k < 0:  # markers: the conversation is there, whether it has turns or not
            for _ in part:
                pass
            k, part = next(passes, (0, iter(())))
        found = Conversation(repairs, part)
        _, texts = next(passes, (1, iter(())))
        yield conv, found, found.repaired(texts)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _reports(kind) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
        types = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for conv, found, turns in _each(batches):
            sha, mark = hashlib.sha256(), b""
            for _, _, role, text in turns:
                sha.update(mark + role + b":")
                sha.update(text)
                mark = b"\n"
            n = found.n
            out.append((conv, found.gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], found.cost, "".join(found.audit), sha.hexdigest()))
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def _rows(kind, size: int = 1 << 22) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, types = ["conv_id", "place", "edit", "turn", "role", "text"], [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        out: list[tuple] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for conv, _, turns in _each(batches):
            for place, (edit, turn, role, text) in enumerate(turns):
                out.append((conv, place, edit, turn, role.decode(), text.decode()))
                held += len(text) + 100
                if held > size:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return run


def _dealt(df: DataFrame, conv_id: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    """Turns by conversation, twice each, in the order in which `_each` takes them."""
    small_batches(df.sparkSession, 4096)
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    body, end = F.coalesce(F.col(text), F.lit(" ")), F.rtrim(F.coalesce(F.col(text), F.lit(" ")), F.lit(BLANK))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    base = df.select(F.col(conv_id).alias("conv_id"), gone.alias("gone"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), body.alias("text"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("digest"), fault.alias("fault"))
    none = F.lit(None)
    one = lambda k, **c: F.struct(F.lit(k).alias("pass"), *[c.get(x, none).cast(t).alias(x) for x, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("fault", "string"), ("text", "string"))])
    key = {k: F.col(k) for k in ("turn", "role", "digest")}
    both = F.when(F.col("gone"), F.array(one(-1))).otherwise(F.array(one(0, **key, fault=F.col("fault")), one(1, **key, text=F.col("text"))))
    rows = base.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pass", F.asc_nulls_first("turn"), "role", "digest")


def _kind(df: DataFrame, conv_id: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[conv_id].dataType), df.schema[conv_id].dataType.simpleString()


def reports(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """For each conversation: gaps (turn numbers that are missing between the first and the last), blank, duplicate,
    truncated (turns by their first fault), illegal (adjacent roles that don't follow each other), cost, audit and
    repaired_sha256 (of `role:text` lines of the repaired conversation).

    Turns go by number, nulls first; turns of one number by role, then by the text's SHA-256.  A null role or text is
    one space, so a null text is blank.  Rows where `absent` holds are no turns; they only say that there is such a
    conversation, which has zeros, an empty audit and the empty string's digest if it has no turns.  Rows without a
    conv_id are one conversation.  An empty table gives an empty result; other columns aren't read.
    """
    arrow, kind = _kind(df, conv_id)
    return _dealt(df, conv_id, turn, role, text, absent).mapInArrow(_reports(arrow), f"conv_id {kind}, {', '.join(c + ' long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def repaired(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), the turn's old number, role and text.

    Order, nulls and repeats as in `reports`; a conversation that nothing is left of has no rows.
    """
    arrow, kind = _kind(df, conv_id)
    return _dealt(df, conv_id, turn, role, text, None).mapInArrow(_rows(arrow), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, absent, turn, role, text of conversations with a fifth of their turns damaged, by the digest of conversation and turn."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(by == 4, "user").otherwise(told("role"))
    return df.select("conv_id", (by == 0).alias("absent"), "turn", role.alias("role"), text.alias("text"), F.explode(F.when(by == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return reports(rows, absent=F.col("absent"))


def crc32_sql(string: str) -> str:
    """DuckDB SQL for the CRC-32 of a string of ASCII characters; it needs the column `crc_steps.steps` of `CRC_STEPS`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({string}, '')]), lambda c, b: xor(c >> 8, crc_steps.steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: The table of CRC-32 remainders, worked out from the polynomial.
CRC_STEPS = """crc_bits(byte, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc_steps AS (SELECT list(c ORDER BY byte) AS steps FROM crc_bits WHERE k = 8)"""


def sql() -> str:
    """The same report by a forward search: for each state of the grammar the least (cost, audit, repaired text)."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    nothing = "{'c': 1000000000::BIGINT, 'a': '', 'r': NULL::VARCHAR}"
    insert = lambda q, role: f"{{'c': {q}.c + 5, 'a': {q}.a || 'I', 'r': concat_ws(chr(10), {q}.r, '{role}:')}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"

    def closed(source: str) -> str:
        first = f"SELECT * REPLACE ({least('qu', insert('q0', 'user'), insert('qs', 'user'), insert('qa', 'user'))} AS qu) FROM ({source})"
        second = f"SELECT * REPLACE ({least('qa', insert('qu', 'assistant'))} AS qa) FROM ({first})"
        return f"SELECT * REPLACE ({least('qu', insert('qa', 'user'))} AS qu) FROM ({second})"

    delete = lambda q: f"{{'c': p.{q}.c + 2, 'a': p.{q}.a || 'D', 'r': p.{q}.r}}"
    keep = lambda q, initial: f"CASE WHEN NOT t.must AND left(t.role, 1) = '{initial}' THEN {{'c': p.{q}.c + t.more, 'a': p.{q}.a || 'K', 'r': concat_ws(chr(10), p.{q}.r, t.role || ':' || t.text)}} ELSE {nothing} END"
    rerole = lambda q, role: f"CASE WHEN NOT t.must THEN {{'c': p.{q}.c + t.more + 1, 'a': p.{q}.a || 'R', 'r': concat_ws(chr(10), p.{q}.r, '{role}:' || t.text)}} ELSE {nothing} END"
    step = f"""SELECT p.conv_id, p.k + 1 AS k, {delete('q0')} AS q0, {least(delete('qs'), keep('q0', 's'))} AS qs,
      {least(delete('qu'), *[f(q, x) for q in ('q0', 'qs', 'qa') for f, x in ((keep, 'u'), (rerole, 'user'))])} AS qu,
      {least(delete('qa'), keep('qu', 'a'), rerole('qu', 'assistant'))} AS qa
    FROM ways p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k + 1"""
    return f"""WITH RECURSIVE {CRC_STEPS}, marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS by_
  FROM conversations, crc_steps
), rows_ AS (
  SELECT conv_id, turn, CASE by_ WHEN 4 THEN 'user' ELSE role END AS role, CASE by_ WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(CASE by_ WHEN 3 THEN 2 ELSE 1 END) WHERE by_ <> 0
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before_, rtrim(text, {blank}) AS body
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), turns AS (
  SELECT conv_id, k, role, text, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM faults
), ways AS (
  {closed(f"SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 'r': NULL::VARCHAR}} AS q0, {nothing} AS qs, {nothing} AS qu, {nothing} AS qa FROM (SELECT DISTINCT conv_id FROM conversations)")}
  UNION ALL {closed(step)}
), ends AS (
  SELECT conv_id, {least('q0', 'qa')} AS best FROM ways QUALIFY k = max(k) OVER (PARTITION BY conv_id)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before_ IS NOT NULL AND before_ || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
