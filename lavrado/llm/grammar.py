"""Weighted finite-state transducers over a text's symbols: negation, reported speech and targets, composed into one.

A transducer reads one symbol and writes one for each token.  Its arcs have weights; of all paths that end in a
final state, the one of the largest sum of weights counts, so a machine may guess what follows (a quotation that
is said to be somebody's only after it, a target behind an insult) and a guess that isn't met dies.

Symbols read: `i` insult, `h` verb of harm, `t` target, `n` negation, `r` verb of saying, `w` other word, `c` comma,
`k` colon, `q` quotation mark, `e` end of a sentence, `z` end of a line.  Between the machines, capitals are negated
and `j`, `g` (capitals too) are reported insults and verbs of harm.  Written at last, for these: `P` plain, `D` directed,
`N` negated, `R` reported, `T` threat; `w` for a verb of harm that is aimed at nobody.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce

WORDS, MARKS = "tnrw", "ckqez"
#: Words between a negation and what it denies, an insult and its target, a quotation and its verb.
NEAR = 3


@dataclass
class Transducer:
    """arcs: state to symbol read to (symbol written, weight, next state); states that may end a text."""

    start: object
    arcs: dict = field(default_factory=dict)
    final: set = field(default_factory=set)

    def arc(self, state, read: str, written: str, after, weight: int = 0) -> None:
        """An arc for each of the symbols in `read`; `written` is one symbol, or the same number of them."""
        for x, y in zip(read, written if len(written) == len(read) else written * len(read)):
            self.arcs.setdefault(state, {}).setdefault(x, []).append((y, weight, after))


def negation() -> Transducer:
    """What follows a negation within NEAR words of its clause is denied."""
    out = Transducer(0, final={0, 1, 2, 3})
    for left in range(NEAR + 1):
        after = max(0, left - 1)
        out.arc(left, "n", "n", NEAR)
        out.arc(left, "trw", "trw", after)
        out.arc(left, "ih", "IH" if left else "ih", after)
        out.arc(left, MARKS, MARKS, 0)
    return out


def report() -> Transducer:
    """What follows a verb of saying, to the end of its sentence or of the quotation that it opens, is reported; so
    is a quotation that a verb of saying follows."""
    plain, marked, passed = "iIhH", "jJgG", "tnwc"
    out = Transducer("plain", final={"plain", "said", "quoted"})
    out.arc("plain", plain + passed + "kez", plain + passed + "kez", "plain")
    out.arc("plain", "r", "r", "said")
    out.arc("plain", "q", "q", "plain")
    out.arc("plain", "q", "q", "guessed")
    out.arc("said", plain + passed + "rk", marked + passed + "rk", "said")
    out.arc("said", "q", "q", "quoted")
    out.arc("said", "ez", "ez", "plain")
    for state, after in (("quoted", "plain"), ("guessed", NEAR)):
        out.arc(state, plain + passed + "rke", marked + passed + "rke", state)
        out.arc(state, "q", "q", after)
    out.arc("quoted", "z", "z", "plain")
    for left in range(1, NEAR + 1):  # words left for the verb that a quotation waits for
        out.arc(left, "c", "c", left)
        out.arc(left, "r", "r", "plain", 100)
        if left > 1:
            out.arc(left, "wt", "wt", left - 1)
    return out


def target() -> Transducer:
    """An insult with a target within NEAR words is directed; harm is a threat if its sentence has a target.

    States: (words for which a target before counts, words left for a target that is guessed, a target has been in the
    sentence, one is guessed to be).
    """
    start = (0, 0, False, False)
    out = Transducer(start, final={start})
    todo = [start]
    while todo:
        state = todo.pop()
        if state in out.arcs:
            continue
        near, hoped, seen, wanted = state
        passed = (max(0, near - 1), hoped - 1, seen, wanted) if hoped != 1 else None  # None: a guess that isn't met
        if hoped == 0:
            passed = (max(0, near - 1), 0, seen, wanted)
        out.arc(state, "t", "t", (NEAR, 0, True, False))
        out.arc(state, "ckq", "ckq", state)
        if passed:
            out.arc(state, "nrwIjJ", "nrwNRN", passed)
            if near or hoped:
                out.arc(state, "i", "D", passed, 1)
            else:
                out.arc(state, "i", "P", passed)
                out.arc(state, "i", "D", (0, NEAR, seen, wanted), 1)
            if seen or wanted:
                out.arc(state, "hHgG", "TNRN", passed, 1)
            else:
                out.arc(state, "hHgG", "w", passed)
                out.arc(state, "hHgG", "TNRN", (passed[0], passed[1], False, True), 1)
        if not hoped and not wanted:
            out.arc(state, "ez", "ez", start)
            out.final.add(state)
        todo += [after for arcs in out.arcs[state].values() for _, _, after in arcs]
    return out


def composed(a: Transducer, b: Transducer) -> Transducer:
    """The machine that writes what b writes when it reads what a writes; weights are added."""
    out = Transducer((a.start, b.start))
    todo = [out.start]
    while todo:
        state = todo.pop()
        if state in out.arcs:
            continue
        out.arcs[state] = {}
        if state[0] in a.final and state[1] in b.final:
            out.final.add(state)
        for x, first in a.arcs.get(state[0], {}).items():
            for y, w, na in first:
                for z, v, nb in b.arcs.get(state[1], {}).get(y, []):
                    out.arcs[state].setdefault(x, []).append((z, w + v, (na, nb)))
                    todo.append((na, nb))
    return out


@lru_cache(maxsize=1)
def machine() -> Transducer:
    """All of the grammar; its states are numbers."""
    whole = reduce(composed, (negation(), report(), target()))
    number = {state: k for k, state in enumerate(whole.arcs)}
    arcs = {number[s]: {x: [(z, w, number[after]) for z, w, after in some] for x, some in by.items()} for s, by in whole.arcs.items()}
    return Transducer(number[whole.start], arcs, {number[s] for s in whole.final})


def best(machine: Transducer, symbols: str) -> str:
    """What the best path writes; of equally good ones the first arcs count."""
    live: dict = {machine.start: (0, None)}
    for x in symbols:
        then: dict = {}
        for state, (weight, path) in live.items():
            for z, w, after in machine.arcs[state].get(x, ()):
                if after not in then or then[after][0] < weight + w:
                    then[after] = (weight + w, (z, path))
        live = then
    ends = [live[s] for s in live if s in machine.final]
    path, out = max(ends, key=lambda x: x[0])[1], []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))
