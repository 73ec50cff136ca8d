"""Sentences, chunks of bounded size, and hard cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import NOT_S, RARE, S, SPACES, WS, B, _holds, _where, trimmed

#: Words whose full stop doesn't end a sentence.
ABBREVIATED = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "Mt", "Rev", "Hon", "e\\.g", "i\\.e", "etc", "cf", "vs", "viz", "al", "Fig", "Eq", "No", "Vol", "approx", "est", "dept", "Inc", "Ltd", "Co")
#: Of letters with full stops the last two tell as much as all.
DANGLING = rf"(?:{B}(?:{'|'.join(ABBREVIATED)})\.|{B}[A-Z]\.|{B}(?:[A-Za-z]\.){{2}}|{B}[0-9]+\.)$"
_DOT = "\u0001"


def regex_sentences(text: Column) -> Column:
    """Splits after a sentence's end mark and white space; full stops that end nothing are masked meanwhile."""
    stop, digit = r"\.(?<=", r"\.(?<=[0-9]\.)"
    # Full stops are few, and cheaper to look for than what stands around them.
    out = F.regexp_replace(trimmed(text), rf"{stop}{B}(?:{'|'.join(ABBREVIATED)})\.)", _DOT)
    out = F.regexp_replace(out, rf"{stop}{B}[A-Z]\.)", _DOT)
    out = _where(out, lambda t: t.rlike(rf"{digit}(?:[0-9]|{S})"), lambda t: F.regexp_replace(t, r"([0-9])\.([0-9])", f"$1{_DOT}$2"))
    out = _where(out, _holds("..."), lambda t: F.regexp_replace(t, r"\.\.\.", _DOT * 3))
    out = _where(out, lambda t: t.rlike(rf"{digit}{S}"), lambda t: F.regexp_replace(t, rf"(?m)^({S}*[0-9]+)\.({S})", f"$1{_DOT}$2"))
    ended = r"(?<=[.!?。！？।])"
    parts = _where(out, lambda t: t.rlike(RARE), lambda t: F.split(t, rf"{ended}{S}+"), lambda t: F.split(t, rf"{ended}\s+"))
    return F.filter(F.transform(parts, lambda s: trimmed(F.replace(s, F.lit(_DOT), F.lit(".")))), lambda s: s != "")


def rejoined(parts: list[str]) -> list[str]:
    """A sentence goes to the one before if that ends in something that ends no sentence. What was glued before changes
    nothing of that, so each sentence is looked at once."""
    out: list[list[str]] = []
    open_end = False
    for s in parts:
        if open_end:
            out[-1].append(s)
        else:
            out.append([s])
        open_end = _dangles(s)
    return [" ".join(x) for x in out]


def _dangles(text: str) -> bool:
    import re

    global _LAST
    _LAST = _LAST or re.compile(DANGLING)
    return text.endswith(".") and bool(_LAST.search(text, max(text.rfind(" "), 0)))


_LAST = None


def merged(parts: list[str], most: int, first_most: int) -> list[str]:
    """Neighbours joined by a space while they fit; the first chunk has a cap of its own. No sentence is split."""
    out: list[list[str]] = []
    size = 0
    for s in parts:
        cap = first_most if len(out) == 1 else most
        if size and size + 1 + len(s) <= cap:
            out[-1].append(s)
            size += 1 + len(s)
        elif out and not size:  # an empty sentence leaves its chunk empty, and the next one takes it
            out[-1] = [s]
            size = len(s)
        else:
            out.append([s])
            size = len(s)
    return [x for x in (" ".join(x) for x in out) if x]


def _in_rows(function: Callable[..., list[str]]):
    """A column function from a text or an array of texts, and whole numbers, to an array of texts. Rows go to Python a hundred
    at a time, so that a worker holds few texts, however large a part is; an Arrow batch holds ten thousand."""

    def work(first, *rest):
        return None if first is None else function(first, *rest)

    return F.udf(work, T.ArrayType(T.StringType()), useArrow=False)


def rejoin_abbreviations(sentences: Column) -> Column:
    """One pass from the left: a sentence goes to the one before if that ends in something that ends no sentence."""
    return _in_rows(rejoined)(sentences)


def merge_short(sentences: Column, most: Column | int, first_most: Column | int | None = None) -> Column:
    """Neighbours joined by a space while they fit; the first chunk has a cap of its own. No sentence is split. The fold holds
    one open chunk, so its time is the text's length; in Python, as Spark's folds copy what they have gathered."""
    return _in_rows(merged)(sentences, *_caps(most, first_most))


def _caps(most: Column | int, first_most: Column | int | None) -> tuple[Column, Column]:
    most = F.lit(most) if isinstance(most, int) else most
    return most, most if first_most is None else F.lit(first_most) if isinstance(first_most, int) else first_most


def chunked(text: Column, most: Column | int, first_most: Column | int | None = None, mode: str = "uax29") -> Column:
    """Chunks of the sentences of a text that is tidied, as `merge_short(sentences(text))`, with one way to Python and back."""
    if mode != "uax29":
        return merge_short(sentences(text, mode), most, first_most)
    return _in_rows(lambda t, *caps: merged(_split(t), *caps))(F.coalesce(text, F.lit("")), *_caps(most, first_most))


def hard_wrap(text: Column, most: int = 1800) -> Column:
    """Pieces of at most `most` characters: cut at the last space past the middle, else at the end; trimmed."""
    half = most // 2 + 1
    pattern = rf"(?s)\G ?(?:(?=.{{{most + 1}}})(?:.{{{half},{most - 1}}}(?= )|.{{{most}}})|.{{1,{most}}}$)"
    cut = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.btrim(p)), lambda p: p != "")
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(cut)


#: Unicode's sentence break rules: what may follow a sentence's end mark.
_IGNORED = r"[\p{SB=EX}\p{SB=FO}]*"
_END = rf"[\p{{SB=ST}}\p{{SB=AT}}]{_IGNORED}"


def uax29(text: str) -> list[str]:
    """Segments of `text` by Unicode's default sentence breaks (rules SB1 to SB998)."""
    import regex

    global _RULES
    if _RULES is None:
        close, space = rf"(?:\p{{SB=CL}}{_IGNORED})*", rf"(?:\p{{SB=SP}}{_IGNORED})*"
        _RULES = {
            "end": regex.compile(rf"(?P<mark>[\p{{SB=ST}}\p{{SB=AT}}]){_IGNORED}(?P<close>{close})(?P<space>{space})(?P<para>\r\n|[\p{{SB=SE}}\r\n])?|(?P<only>\r\n|[\p{{SB=SE}}\r\n])"),
            "at": regex.compile(r"\p{SB=AT}"),
            "number": regex.compile(r"\p{SB=NU}"),
            "upper": regex.compile(r"\p{SB=UP}"),
            "cased": regex.compile(r"[\p{SB=UP}\p{SB=LO}]"),
            "ignored": regex.compile(r"[\p{SB=EX}\p{SB=FO}]"),
            "lower_ahead": regex.compile(rf"(?:[^\p{{SB=LE}}\p{{SB=UP}}\p{{SB=LO}}\p{{SB=SE}}\r\n\p{{SB=ST}}\p{{SB=AT}}])*\p{{SB=LO}}"),
            "goes_on": regex.compile(r"[\p{SB=SC}\p{SB=ST}\p{SB=AT}]"),
        }
    r, out, start, at = _RULES, [], 0, 0
    while m := r["end"].search(text, at):
        end = at = m.end()
        if m["only"] is None and not m["para"]:
            if end == len(text):
                break
            full = r["at"].match(m["mark"])
            bare = not m["close"] and not m["space"]
            if full and bare and r["number"].match(text, end):  # SB6
                continue
            if full and bare and r["upper"].match(text, end) and _cased_before(text, start, m.start()):  # SB7
                continue
            if full and r["lower_ahead"].match(text, end):  # SB8
                continue
            if r["goes_on"].match(text, end):  # SB8a
                continue
        out.append(text[start:end])
        start = end
    if start < len(text):
        out.append(text[start:])
    return out


_RULES: dict | None = None


def _cased_before(text: str, start: int, at: int) -> bool:
    """Whether the last character from `start` up to `at`, of those that count, is a letter with case."""
    at -= 1
    while at >= start and _RULES["ignored"].match(text, at):
        at -= 1
    return at >= start and bool(_RULES["cased"].match(text, at))


def _split(text: str) -> list[str]:
    return rejoined([s for s in (x.strip(SPACES) for x in uax29(text.strip(SPACES))) if s])


def uax29_sentences(text: Column) -> Column:
    """Trimmed Unicode sentences of the trimmed text, repaired after abbreviations."""
    return _in_rows(_split)(F.coalesce(text, F.lit("")))


def sentences(text: Column, mode: str = "uax29") -> Column:
    """Sentences of a text that is tidied; `mode` as in Settings.sentences."""
    if mode not in ("regex", "uax29"):
        raise ValueError(f"no sentence mode {mode!r}")
    return uax29_sentences(text) if mode == "uax29" else regex_sentences(text)


__all__ = ["NOT_S", "WS", "chunked", "hard_wrap", "merge_short", "regex_sentences", "rejoin_abbreviations", "sentences", "uax29", "uax29_sentences"]
