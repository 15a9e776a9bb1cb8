"""Text functions as Column expressions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

#: Where Python's splitlines() cuts.
LINE_END = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085  ]"


#: Unicode's white space, and the separators U+001C to U+001F.
WHITE = "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), with c computed once however often `of` uses it."""
    return F.transform(F.array(c), of)[0]


def unless_empty(c: Column) -> Column:
    """c, or null if it is an empty string; c is computed once (nullif() computes it twice inside of a lambda)."""
    return F.try_element_at(F.array_remove(F.array(c), F.lit("")), F.lit(1))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (SQL's trim takes spaces only unless it is told what to take)."""
    return F.trim(c, F.lit(WHITE))


def stripped_line(c: Column) -> Column:
    """strip() of a text that is bound, such as a line: one that begins and ends with visible ASCII is as it is, which is told
    without looking characters up."""
    seen = lambda x: (x > " ") & (x < "\u007f")
    return F.when(seen(F.left(c, F.lit(1))) & seen(F.right(c, F.lit(1))), c).otherwise(strip(c))


def squeezed(c: Column) -> Column:
    """Runs of spaces, tabs and no-break spaces become one space; line ends stay."""
    has = lambda x: F.contains(c, F.lit(x))
    other = F.regexp_replace(c, "[ \t\u00a0]{2,}|[\t\u00a0]", " ")
    return strip(F.when(has("\t") | has("\u00a0"), other).when(has("  "), F.regexp_replace(c, "  +", " ")).otherwise(c))


@lru_cache(maxsize=1)
def translations() -> tuple[str, str, str]:
    """Every character of Unicode that decomposes to ASCII: those that become one character and what they become, and the others as a JSON object."""
    plain = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)])}
    single = {c: x for c, x in plain.items() if len(x) == 1}
    return "".join(single), "".join(single.values()), json.dumps({c: x for c, x in plain.items() if len(x) > 1}, ensure_ascii=False)


@lru_cache(maxsize=1)
def usual() -> tuple[str, str]:
    """Latin letters and punctuation that become one character or none, those with none last, and what they become: few, so
    that looking one up is cheap."""
    plain = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, [*range(0x80, 0x180), *range(0x2010, 0x2028), 0x20AC])}
    single = {c: x for c, x in plain.items() if len(x) == 1}
    return "".join(single) + "".join(c for c, x in plain.items() if not x), "".join(single.values())


def ascii_only(c: Column) -> Column:
    """As many bytes as characters: counting is far cheaper than looking for another character."""
    return F.octet_length(c) == F.length(c)


def _unless_ascii(then: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(ascii_only(x), x).otherwise(then(x))


def _beyond(text: Column) -> Column:
    """What usual() has left over: characters that become one other are translated, rare ones are each looked up once a text."""
    other = "[^\\x00-\\x7F]"

    def rest(text: Column) -> Column:
        known = F.from_json(F.lit(translations()[2]), "map<string,string>")  # one literal, once the plan is optimised
        rare = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({other})"), F.lit(1)))
        pairs = F.filter(F.transform(rare, lambda x: F.struct(x.alias("from"), known[x].alias("to"))), lambda p: p["to"].isNotNull())
        return F.regexp_replace(F.aggregate(pairs, text, lambda t, p: F.replace(t, p["from"], p["to"])), f"{other}+", "")

    return once(F.translate(text, *translations()[:2]), _unless_ascii(rest))


def _translated(text: Column) -> Column:
    return once(usual_only(text), _unless_ascii(_beyond))


def usual_only(c: Column) -> Column:
    """A text with usual() looked up: if it is ASCII then, its upper case is folded(c)."""
    return F.translate(c, *usual())


def squeezed_usual(c: Column, usual_: Column, squeezed_: Column) -> Column:
    """usual_only() of the squeezed form of a text of which usual_only() is at hand.  Where each character became one of ASCII,
    and none but spaces became a space, that can be squeezed instead."""
    blanks = [x for x, y in zip(*usual()) if y == " " and x not in WHITE]
    apart = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in ("\t", "\u00a0", *blanks)])
    return F.when(ascii_only(usual_) & (F.length(usual_) == F.length(c)) & ~apart, strip(F.regexp_replace(usual_, "  +", " "))).otherwise(usual_only(squeezed_))


def folded_usual(usual_: Column) -> Column:
    """folded() of a text of which usual_only() is at hand."""
    return F.upper(_unless_ascii(_beyond)(usual_))


def folded_line(c: Column) -> Column:
    """folded() of a short text that is bound, such as a line: without cutting it first."""
    return F.upper(F.when(ascii_only(c), c).otherwise(_translated(c)))


def folded(c: Column) -> Column:
    """Compatibility decomposition, what isn't ASCII dropped, upper case.  Only lines with other characters are looked up,
    character by character."""
    return F.upper(F.when(ascii_only(c), c).otherwise(F.array_join(F.transform(F.split(c, "\n"), _unless_ascii(_translated)), "\n")))


def digits(c: Column) -> Column:
    """0-9 only; null gives an empty string."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def tidy(c: Column, usual_: Column | None = None) -> Column:
    """A text's lines end in U+000A only, and but for its first and last line none has white space at its ends.  So has any part
    of it; told once a text, it spares a search in each of its lines.  usual_: c as of usual_only(), if it is at hand."""
    has = lambda what: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in what])
    rare = [x for x in WHITE if not x.isascii() and x not in usual()[0]]
    # If all of a text's characters are usual ones, it has no rare white space.
    return ~has([" \n", "\n ", *(x for x in WHITE if x not in " \n" and x not in rare)]) & (~has(rare) if usual_ is None else ascii_only(usual_) | ~has(rare))


def cut_lines(c: Column, plain: Column | None = None) -> Column:
    """A text cut at its line ends; one whose line ends are all U+000A is cut there, which needs no search by pattern.
    plain: whether the text that c is a part of is tidy()."""
    odd = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(e)) for e in "\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029"])
    return once(c, lambda x: F.when(~odd(x) if plain is None else plain, F.split(x, "\n")).otherwise(F.split(x, LINE_END)))


def lines(c: Column, plain: Column | None = None) -> Column:
    """The lines of a text; a last line end opens no further line.  plain: whether the text that c is a part of is tidy()."""
    return once(cut_lines(c, plain), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))


def literal(what: str) -> str:
    """A pattern of a string and nothing else, for which a search skips ahead; instr() and contains() try every place."""
    return re.sub("([^A-Za-z0-9])", r"\\\1", what)


def place(upper: Column, what: str) -> Column:
    """The place (from 1) of a string in a folded text; 0 if it isn't there."""
    return F.regexp_instr(upper, F.lit(literal(what)))


def first_place(where: Column, headers: Sequence[str]) -> Column:
    """The least place (from 1) of any of the headers; null if none occurs."""
    return F.array_min(F.filter(F.array(*[place(where, h) for h in headers]), lambda x: x > 0))


def section(text: Column, starts: Sequence[str], ends: Sequence[str], upper: Column | None = None) -> Column:
    """From the first of the start headers to the first end header after it, headers found in the folded text
    (`upper`, if it is at hand).

    Places are the folded text's, applied to the text itself; null if no start header occurs.
    """

    def cut(u: Column, start: Column) -> Column:
        return F.substr(text, start, F.coalesce(once(F.substr(u, start + F.lit(1)), lambda after: first_place(after, ends)), F.length(text)))

    # Arrays of one element, so that the folded text and the place are computed once.
    each = F.transform(F.array(folded(text) if upper is None else upper), lambda u: F.transform(F.array(first_place(u, starts)), lambda k: F.when(k.isNotNull(), cut(u, k))))
    return each[0][0]


def window(text: Column, upper: Column, label: str, size: int, skip: bool = False) -> Column:
    """`size` characters of the text from where the folded text has the label (or from its end); null if it has not."""
    return once(place(upper, label), lambda k: F.when(k > 0, F.substr(text, k + F.lit(len(label) if skip else 0), F.lit(size))))


def full_lines(c: Column, plain: Column | None = None) -> Column:
    """The lines that aren't blank, stripped.  plain: whether the text that c is a part of is tidy()."""
    each = lambda x, by: F.filter(F.transform(cut_lines(x, by), stripped_line), lambda y: y != "")
    if plain is None:
        return each(c, None)
    return once(c, lambda x: F.when(plain, F.array_remove(F.split(strip(x), "\n"), F.lit(""))).otherwise(each(x, F.lit(False))))


def stripped_of(c: Column, characters: str) -> Column:
    """Without any of some characters at both ends."""
    return F.trim(c, F.lit(characters))


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter, small letters after letters."""
    each = F.regexp_extract_all(c, F.lit("(\\p{L}+|\\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(each, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def markdown(text: Column, title: Column) -> Column:
    """A text as Markdown: title, lines without trailing blanks, one empty line at most in a row, lines of
    capitals of 3 to 10 words as second-level headings, one line end at last.  An empty text is the bare title."""
    # Fixed value: what a heading's line may hold.
    heading = "^[A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 ,.:;/()\\-—+%R$°ºª'\"]{6,}$"
    ends = F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.regexp_replace(x, "(?U)[\\s\u001c-\u001f]+$", ""))
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit("(?U)(\\S+)")))
    marked = lambda s: F.when(s.rlike(heading) & words(s).between(3, 10), F.concat(F.lit("## "), s))
    shown = F.transform(ends, lambda x: F.coalesce(F.transform(F.array(strip(x)), marked)[0], x))
    body = F.regexp_replace(F.regexp_replace(F.array_join(shown, "\n"), "^\n+", "\n"), "\n{3,}", "\n\n")
    named = F.nullif(title, F.lit(""))
    head = F.when(named.isNotNull(), F.concat(F.lit("# "), strip(named), F.lit("\n\n"))).otherwise("")
    whole = F.concat(F.regexp_replace(F.concat(head, body), "\n+$", ""), F.lit("\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.coalesce(named, F.lit(""))).otherwise(whole)
