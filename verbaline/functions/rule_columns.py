"""The rule tokenizer as column expressions: what rules.py states for a string, in built-in functions only.

Affixes are peeled from both ends in turns. Taken by themselves, the prefixes from the left and the suffixes from the right
are lists that one pass of a regular expression gives; the turns differ from them only where the two lists meet. So as many
turns as leave something between them are taken from the lists, and the few code points that are left are peeled turn by
turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbaline.functions import rules
from verbaline.functions.text import SPACE

#: The usual characters come first in these, as the list of white space is long to go through.
SOLID, BLANK = rf"[!-~[^{SPACE}]]", rf"(?:\x20|(?![!-~])[{SPACE}])"
#: A white-space run gives a leading space to the run before it; what is left of it is a token.
UNIT = rf"{SOLID}+\x20?|[{SPACE}]+"
#: Every rule needs a character outside this class to act on; no prefix begins with one of ASCII's letters and digits
#: (but signs like US$, where they are prefixes), and no suffix ends with one but s. Classes of few ranges are tested fast, so they come before the long lists of the rules.
OTHER = "[^0-9A-Za-z\u00c0-\u024f]"
NO_PREFIX, NO_SUFFIX = r"\A[0-9A-Za-z]", r"[0-9A-RT-Za-rt-z]\z"
#: Turns that what is left between the two lists can take: affixes have three code points at most, but for a run of dots.
TURNS = 8
#: Chunks of plain characters alone, one token, and such with one sign after them that is always a suffix there, two tokens.
PLAIN, EDGE = "[a-z0-9A-Z\u00c0-\u024f]++", rf"(?={BLANK}|\z)"
WITH_SIGN = rf"{PLAIN}(?:[,;:!?)]|(?<=[0-9a-z])\.){EDGE}"
BEGIN = rf"(?:(?<=\x20)|(?<!{SOLID}))"
#: Stands for no text: U+0001 is written as U+0001 U+0002 while U+0001 U+0003 parts a core.
ONE, TWO, THREE = "\x01", "\x02", "\x03"


def suffix_reversed() -> str:
    """rules.suffix() for a reversed chunk, the longest alternative first: what stood before a suffix now follows it."""
    before_dot = "0-9a-z" + rules.char_class("%²-+|(?:)" + "".join(rules.PUNCTS + rules.QUOTES))
    back = lambda words: sorted({w[::-1] for w in words if w}, key=lambda w: (-len(w), w))
    entries = [r"\.{2,}+", *rules.escaped(back([*rules.PUNCTS, "…", *rules.QUOTES, *rules.POSSESSIVE, "—", "–"]))]
    entries += [r"\+(?=[0-9])", r"\.(?=[FfCcKk]°)", f"(?:{'|'.join(rules.escaped(back(rules.CURRENCY)))})(?=[0-9])", rf"\.(?=[{before_dot}])", r"\.(?=[A-Z][A-Z])"]
    return f"(?:{'|'.join(entries)})"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def core_pieces(core: Column) -> Column:
    """A core whole if it is a URL or has no infix, else cut at its infixes."""
    infix = rules.infix().pattern
    marked = F.regexp_replace(F.replace(core, F.lit(ONE), F.lit(ONE + TWO)), F.lit(infix), F.lit(f"{ONE}{THREE}$0{ONE}{THREE}"))
    cut = F.filter(F.split(marked, ONE + THREE), lambda x: x != "")
    cut = F.transform(cut, lambda x: F.replace(x, F.lit(ONE + TWO), F.lit(ONE)))
    whole = ~core.rlike(OTHER) | F.contains(core, F.lit("http://")) | ~core.rlike(infix)
    return F.when(core == "", F.array().cast("array<string>")).when(whole, F.array(core)).otherwise(cut)


def peeled(chunk: Column, currency: bool = False) -> Column:
    """struct(front, core, back) of a chunk: prefixes, what is left, suffixes in text order."""
    front, back = rules.prefix(currency).pattern, suffix_reversed()

    def taken(x: Column) -> Column:
        """From the lists p and s: as many turns k as leave something, with the code points f and b they take on either side."""
        step = lambda a, t: let(F.struct((a["f"] + F.coalesce(F.length(t["p"]), F.lit(0))).alias("f"), (a["b"] + F.coalesce(F.length(t["s"]), F.lit(0))).alias("b")), lambda y: F.when(a["on"] & (y["f"] + y["b"] < x["n"]), F.struct((a["k"] + 1).alias("k"), y["f"].alias("f"), y["b"].alias("b"), F.lit(True).alias("on"))).otherwise(F.struct(a["k"].alias("k"), a["f"].alias("f"), a["b"].alias("b"), F.lit(False).alias("on"))))
        none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("f"), F.lit(0).alias("b"), F.lit(True).alias("on"))
        return F.aggregate(F.arrays_zip(x["p"].alias("p"), x["s"].alias("s")), none, step)

    def turn(a: Column, _: Column) -> Column:
        def rest(p: Column) -> Column:
            return let(F.substring(a["core"], F.length(p) + 1, F.length(a["core"])), lambda r: let(F.regexp_extract(F.reverse(r), rf"\A{back}", 0), lambda s: F.struct(
                F.when(p == "", a["front"]).otherwise(F.concat(a["front"], F.array(p))).alias("front"), F.substring(r, F.lit(1), F.length(r) - F.length(s)).alias("core"),
                F.when(s == "", a["back"]).otherwise(F.concat(a["back"], F.array(s))).alias("back"))))

        return let(F.regexp_extract(a["core"], rf"\A{front}", 0), rest)

    def state(x: Column, t: Column) -> Column:
        core = F.substring(chunk, t["f"] + 1, x["n"] - t["f"] - t["b"])
        return F.struct(F.slice(x["p"], F.lit(1), t["k"]).alias("front"), core.alias("core"), F.slice(x["s"], F.lit(1), t["k"]).alias("back"))

    def turns(x: Column) -> Column:
        every = F.struct(F.greatest(F.size(x["p"]), F.size(x["s"])).alias("k"), F.length(F.array_join(x["p"], "")).alias("f"), F.length(F.array_join(x["s"], "")).alias("b"))
        return let(every, lambda t: F.when(t["f"] + t["b"] < x["n"], state(x, t)).otherwise(meeting(x)))

    def meeting(x: Column) -> Column:
        return (let(taken(x), lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), state(x, t), turn)))

    none = F.array().cast("array<string>")
    p = F.when(chunk.rlike(NO_PREFIX.replace("A-Z", "BD-TV-Z") if currency else NO_PREFIX), none).otherwise(F.regexp_extract_all(chunk, F.lit(rf"\G{front}"), 0))
    s = F.when(chunk.rlike(NO_SUFFIX), none).otherwise(F.regexp_extract_all(F.reverse(chunk), F.lit(rf"\G{back}"), 0))
    lists = F.struct(p.alias("p"), s.alias("s"), F.length(chunk).alias("n"))
    done = let(lists, turns)
    return let(done, lambda d: F.struct(d["front"].alias("front"), d["core"].alias("core"), F.reverse(F.transform(d["back"], F.reverse)).alias("back")))


def chunk_pieces(chunk: Column, currency: bool = False) -> Column:
    """array<string>: the tokens of a chunk, which depend on the chunk alone."""
    cut = let(peeled(chunk, currency), lambda x: F.concat(x["front"], core_pieces(x["core"]), x["back"]))
    return F.when(chunk.rlike(OTHER), cut).otherwise(F.array(chunk))


def units(text: Column) -> Column:
    """Runs of non-spaces with the one space that follows, and what white space is left between them."""
    return F.regexp_extract_all(text, F.lit(UNIT), 0)


def unit_pieces(unit: Column, currency: bool = False) -> Column:
    chunk = F.when(F.endswith(unit, F.lit(" ")), F.substring(unit, F.lit(1), F.length(unit) - 1)).otherwise(unit)
    return F.when(unit.rlike(rf"\A[{SPACE}]"), F.array(unit)).otherwise(let(chunk, lambda c: chunk_pieces(c, currency)))


def rule_tokens(text: Column, currency: bool = False) -> Column:
    """array<struct<token, spacy>>: the tokens of a text in order; spacy tells that one space follows. Null text: null."""
    def one(u: Column) -> Column:
        spaced = u.rlike(rf"\A[^{SPACE}]") & F.endswith(u, F.lit(" "))
        return let(F.struct(unit_pieces(u, currency).alias("p"), spaced.alias("s")), lambda x: F.transform(x["p"], lambda t, j: F.struct(t.alias("token"), (x["s"] & (j == F.size(x["p"]) - 1)).alias("spacy"))))

    return F.flatten(F.transform(units(text), one))


def count(text: Column, currency: bool = False) -> Column:
    """The number of tokens of a text. Plain chunks, most of all, and white space are counted in the text as it is; only the other
    chunks are taken apart. Null text: null."""
    many = lambda pattern: F.regexp_count(text, F.lit(pattern))
    blank = SPACE.replace(r"\x20", "")
    spaces = many(rf"\A{BLANK}|(?<={SOLID})(?:\x20{BLANK}|(?![!-~])[{blank}])")
    others = F.regexp_extract_all(text, F.lit(rf"{BEGIN}(?!{PLAIN}{EDGE}|{WITH_SIGN}){SOLID}+"), 0)
    return F.aggregate(others, (spaces + many(f"{BEGIN}{PLAIN}{EDGE}") + 2 * many(BEGIN + WITH_SIGN)).cast("long"), lambda a, c: a + F.size(chunk_pieces(c, currency)))


def spaced(text: Column) -> Column:
    """How many tokens one space follows: those that end a run of non-spaces before a space."""
    return F.regexp_count(text, F.lit(rf"(?<={SOLID})\x20")).cast("long")
