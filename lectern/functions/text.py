"""Text functions as Spark expressions: brackets, abbreviations, units, addresses, tidying, tables, code, labels.

White space is that of web pages' scripts, which knows more of it than Java's \\s, and word edges are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as the inside of a character class, and edges of ASCII words.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S, NOT_S = f"[{WS}]", f"[^{WS}]"
B, E = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def at_word(first: str, rest: str) -> str:
    """`first` and `rest` where a word starts. The letter stands before the test of what precedes it: it is looked for
    quickly, and the test is made only where it is found: text_normalize at sf0.1 in one task took 24 s so, and 45 s with the
    test first."""
    return f"{first}(?<![A-Za-z0-9_]{first}){rest}"


#: Rewritings in their order, as (pattern, replacement).
ABBREVIATIONS = (
    ("(?i)" + at_word("e", rf"\.{S}?g\.{S}*"), "for example, "),
    ("(?i)" + at_word("i", rf"\.{S}?e\.{S}*"), "that is, "),
    ("(?i)" + at_word("e", rf"tc\.(?={S}|$)"), "et cetera"),
    ("(?i)" + at_word("v", rf"s\.?(?={S})"), "versus"),
    ("(?i)" + at_word("c", rf"f\.(?={S})"), "compare"),
    ("(?i)" + at_word("v", rf"iz\.(?={S})"), "namely"),
    ("(?i)" + at_word("a", rf"pprox\.(?={S})"), "approximately"),
    (at_word("F", rf"ig\.{S}*(?=[0-9])"), "Figure "),
    (at_word("E", rf"q\.{S}*(?=[0-9])"), "Equation "),
    (at_word("V", rf"ol\.{S}*(?=[0-9])"), "Volume "),
    (at_word("N", rf"o\.{S}*(?=[0-9])"), "Number "),
    (at_word("D", rf"r\.{S}+"), "Doctor "),
    (at_word("P", rf"rof\.{S}+"), "Professor "),
    (at_word("M", rf"r\.{S}+"), "Mister "),
    (at_word("M", rf"rs\.{S}+"), "Missus "),
    (at_word("M", rf"s\.{S}+"), "Miss "),
    (at_word("S", rf"t\.{S}+"), "Saint "),
    ("(?i)" + at_word("e", rf"t{S}+al\."), "and others"),
)
#: Signs of money, units and the rest of the rewritings.
CURRENCY = (("\\$", "dollars"), ("₹", "rupees"), ("€", "euros"), ("£", "pounds"))
UNITS = (
    ("km", "kilometers"),
    ("kg", "kilograms"),
    ("cm", "centimeters"),
    ("mm", "millimeters"),
    ("ft", "feet"),
    ("GHz", "gigahertz"),
    ("Hz", "hertz"),
    ("TB", "terabytes"),
    ("GB", "gigabytes"),
    ("MB", "megabytes"),
    ("KB", "kilobytes"),
)
#: With the sign that each needs.
TAIL = (
    ("&", f"{S}&{S}", " and "),
    ("%", f"([0-9]){S}?%", "$1 percent"),
    ("#", "#(?=[0-9])", "number "),
    ("/", "(?i)" + at_word("a", f"nd/or{E}"), "and or"),
    ("+", f"{S}\\+{S}", " plus "),
    ("=", f"{S}={S}", " equals "),
    ("@", f"({NOT_S})@({NOT_S})", "$1 at $2"),
)
#: Words for signs of code, captions that say nothing, scripts without spaces, steps of speed, addresses that
#: are never read.
CODE_WORDS = (
    ("=>", " arrow "),
    ("===|==", " equals "),
    ("!==|!=", " not equals "),
    ("&&", " and "),
    ("\\|\\|", " or "),
    ("[{}()\\[\\];]", " "),
    ("_", " underscore "),
)
JUNK_CAPTION = r"(?i)^(image|photo|picture|figure|graphic|icon|logo|screenshot|advertisement)\.?$"
WIDE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f"
SPEEDS = (0.5, 0.75, 0.9, 1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0)
UNREADABLE = (
    "chrome://",
    "chrome-extension://",
    "edge://",
    "about:",
    "https://chromewebstore.google.com",
    "https://chrome.google.com/webstore",
    "https://microsoftedge.microsoft.com/addons",
)
BREAK, LONG_BREAK = " [break]", " [long-break]"


#: White space as single characters.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: Where nothing of this is found, white space is ASCII, and quotes, dashes and the like are plain.
RARE = "[\u00A0\u00AD\u1680-\uFEFF]"
#: Where none of these is found no abbreviation is rewritten. Full stops are few, so they are looked for first; short words
#: without one are looked for by themselves.
_STOPPED = rf"\.(?:(?<=(?<![A-Za-z0-9_])(?:[eE][tT][cC]|[cC][fF]|[vV][sS]|[vV][iI][zZ]|[aA][pP][pP][rR][oO][xX]|Dr|Prof|Mr|Mrs|Ms|St)\.)|(?<=(?<![A-Za-z0-9_])[eE]\.){S}?[gG]\.|(?<=(?<![A-Za-z0-9_])[iI]\.){S}?[eE]\.|(?<=(?<![A-Za-z0-9_])(?:Fig|Eq|Vol|No)\.){S}*[0-9]|(?<={S}[aA][lL]\.))"
_UNIT = rf"[0-9]{S}?(?:{'|'.join(unit for unit, _ in UNITS)})(?![A-Za-z0-9_])"


def _where(text: Column, test, then, otherwise=None) -> Column:
    """`then` of the texts that pass the test, the others as they are or `otherwise`. Rewritings that find nothing change
    nothing, and a look for a rare sign is far cheaper than they are. The text is computed once for all three."""
    other = otherwise or (lambda t: t)
    return F.get(F.transform(F.array(text), lambda t: F.when(test(t), then(t)).otherwise(other(t))), F.lit(0))


def _holds(*signs: str):
    def test(text: Column) -> Column:
        out = F.contains(text, F.lit(signs[0]))
        for sign in signs[1:]:
            out = out | F.contains(text, F.lit(sign))
        return out

    return test


def _any_case(sign: str) -> list[str]:
    out = [""]
    for c in sign:
        out = [x + y for x in out for y in sorted({c.lower(), c.upper()})]
    return out


def _fold(text: Column, pairs) -> Column:
    for pattern, to in pairs:
        text = F.regexp_replace(text, pattern, to)
    return text


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _collapse_plain(text: Column) -> Column:
    """Of a text whose white space is ASCII; single spaces stay as they are."""
    return F.btrim(F.regexp_replace(text, r"(?:[\t\n\x0B\f\r]| (?=\s))\s*", " "))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return _where(text, lambda t: t.rlike(RARE), lambda t: F.btrim(F.regexp_replace(t, f"{S}+", " ")), _collapse_plain)


def strip_brackets(text: Column) -> Column:
    """Reference and editorial marks go; other bracketed words stay without their brackets; no bracket is left."""
    return _where(text, _holds("[", "]"), _strip_brackets)


def _strip_brackets(text: Column) -> Column:
    text = F.regexp_replace(text, rf"(?i)\[{S}*(?:[0-9]+|[a-z]|citation needed|edit|sic|note [0-9]+|\.\.\.|…){S}*\]", "")
    text = F.regexp_replace(text, rf"\[{S}{{0,80}}\]", " ")
    text = F.regexp_replace(text, rf"\[(?=[^\]]{{0,80}}\]){S}*([^\]]*?){S}*\]", " $1 ")
    return F.regexp_replace(text, r"[\[\]]", "")


def expand_abbreviations(text: Column) -> Column:
    text = _where(text, lambda t: t.rlike(_STOPPED) | _holds(*_any_case("vs"))(t), lambda t: _fold(t, ABBREVIATIONS))
    for sign, name in CURRENCY:
        text = _where(text, _holds(sign[-1]), lambda t, sign=sign, name=name: F.regexp_replace(t, rf"{sign}{S}?([0-9][0-9,]*(?:\.[0-9]+)?)", f"$1 {name}"))
    text = _where(text, lambda t: t.rlike(_UNIT), lambda t: _fold(t, [(f"([0-9]){S}?{unit}(?![A-Za-z0-9_])", f"$1 {name}") for unit, name in UNITS]))
    for sign, pattern, to in TAIL:
        text = _where(text, _holds(sign), lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to))
    return text


def collapse_urls(text: Column) -> Column:
    """Mail addresses to 'email at host', web addresses to their host read aloud."""
    text = _where(text, _holds("@"), lambda t: F.regexp_replace(t, rf"{B}[A-Za-z0-9_.+-]++@([A-Za-z0-9_-]+)\.[A-Za-z0-9_.]+", "email at $1"))
    return _where(text, _holds("://", *_any_case("ww."), "\u0002", "\u0003"), _collapse_urls)


def _collapse_urls(text: Column) -> Column:
    # Hosts, which hold no white space, stand between two control characters while their dots are rewritten.
    text = F.regexp_replace(text, "(?i)" + at_word("h", rf"ttps?://(?:www\.)?([^{WS}/]+){NOT_S}*"), "\u0002$1\u0003")
    text = F.regexp_replace(text, "(?i)" + at_word("w", rf"ww\.([^{WS}/]+){NOT_S}*"), "\u0002$1\u0003")
    text = F.regexp_replace(text, f"\\.(?=[^{WS}\u0002\u0003]*\u0003)", " dot ")
    return F.regexp_replace(text, "[\u0002\u0003]", "")


def tidy(text: Column) -> Column:
    """Invisible characters go, quotes are straight, dashes are spaced, white space is collapsed."""
    return _where(text, lambda t: t.rlike(RARE), _tidy, _collapse_plain)


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, "[\u200b-\u200d\ufeff\u00ad]", "")
    text = F.translate(text, "\u2018\u2019\u201b\u201c\u201d\u201f", "'''\"\"\"")
    text = F.regexp_replace(text, "[\u2013\u2014\u2212]", " - ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "\u2026", "..."), f"{S}+", " "))


def normalize_prose(text: Column) -> Column:
    return tidy(expand_abbreviations(collapse_urls(strip_brackets(text))))


def is_speakable(text: Column) -> Column:
    """Has a letter or a number."""
    return text.rlike(r"[\p{L}\p{N}]")


def linearize_table(text: Column, cells: Column) -> Column:
    """Rows with each cell under its header; without two rows of cells, the text."""

    def row(cells_of_row: Column, i: Column) -> Column:
        head = F.get(cells, F.lit(0))
        said = F.transform(
            cells_of_row,
            lambda cell, j: F.when(trimmed(F.coalesce(cell, F.lit(""))) == "", F.lit(None).cast("string")).otherwise(
                F.when(F.coalesce(F.get(head, j), F.lit("")) != "", F.concat(trimmed(F.get(head, j)), F.lit(", "), trimmed(cell))).otherwise(trimmed(cell))
            ),
        )
        return F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(said, "; "), F.lit("."))

    body = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    paired = F.concat(F.lit("Table with "), (F.size(cells) - 1).cast("string"), F.lit(" rows. "), F.array_join(F.transform(body, row), " "))
    return F.when(F.coalesce(F.size(cells), F.lit(-1)) >= 2, paired).otherwise(F.concat(F.lit("Table. "), text))


def speakable_code(code: Column) -> Column:
    return collapse(_fold(code, CODE_WORDS))


def clean_code(code: Column) -> Column:
    """Line ends unified, blanks at line ends cut, one empty line of a run kept, none at the ends."""
    code = F.regexp_replace(code, "\r\n?", "\n")
    code = F.regexp_replace(code, "(?m)[ \t]+$", "")
    code = F.regexp_replace(code, "\n{3,}", "\n\n")
    return F.regexp_replace(code, "^\n+|\n+$", "")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def whitespace_words(text: Column) -> Column:
    """Words between white space, none in an empty text. Counted by the spaces between them: a list of all words is as large as
    the text, and looking at each character for a dozen kinds of white space takes many times longer."""
    spaced = lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + (t != "").cast("int")
    return F.get(F.transform(F.array(collapse(text)), spaced), F.lit(0))


def word_count(text: Column) -> Column:
    """Each character of scripts written without spaces is a word; the rest is counted between white space."""
    wide = lambda t: F.regexp_count(t, F.lit(f"[{WIDE}]")) + whitespace_words(F.regexp_replace(t, f"[{WIDE}]", " "))
    return _where(text, lambda t: t.rlike("[\u0e00-\uffff]"), wide, whitespace_words)


def detect_lang(*sources: Column) -> Column:
    """The first source that is not blank, its first tag; 'en' if there is none."""
    tags = [F.nullif(trimmed(F.split(s, ",")[0]), F.lit("")) for s in sources]
    return F.coalesce(*tags, F.lit("en"))


def url_host(url: Column) -> Column:
    """Lower-case host, without 'www.'."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), "^www\\.", "")


def host_matches(url: Column, *domains: str) -> Column:
    """The host is one of the domains or below one."""
    host, out = url_host(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def blocked_url(url: Column) -> Column:
    """Pages that are never read: browsers' own and extension stores."""
    out = F.lit(False)
    for start in UNREADABLE:
        out = out | F.coalesce(url, F.lit("")).startswith(start)
    return out


def display_text(text: Column) -> Column:
    """Without pause marks."""
    return collapse(F.regexp_replace(text, r"\[(?:long-)?break\]", ""))


def display_class(kind: Column) -> Column:
    out = F.when(kind == "heading", "heading").when(kind == "quote", "quote").when(kind == "list-item", "item")
    return out.when(kind.isin("code", "table"), "skipped").otherwise("plain")


def duration_label(seconds: Column) -> Column:
    """Minutes to listen, rounded half up."""
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").when(minutes < 1, "under a minute").otherwise(F.concat(minutes.cast("string"), F.lit(" min listen")))


def chunk_label(chars: Column) -> Column:
    note = F.when(chars <= 400, "starts fast, choppier").when(chars >= 1400, "smoothest, slower start").otherwise("balanced")
    return F.concat(chars.cast("string"), F.lit(" chars · "), note)


def speed_label(speed: Column) -> Column:
    return F.concat(speed.cast("double").cast("string"), F.lit("×"))


def cost_label(billed: Column, price: Column, reused: Column) -> Column:
    """Bytes billed, what they cost at a price a million bytes, and what the cache saved."""
    usd = billed / F.lit(1e6) * price
    cost = F.when(price == 0, "free model").when((usd > 0) & (usd < 0.01), "under a cent").otherwise(F.concat(F.lit("$"), F.format_string("%.3f", usd)))
    saved = F.when(reused > 0, F.concat(F.lit(" · "), reused.cast("string"), F.lit(" reused"))).otherwise("")
    return F.concat(F.format_number(billed, 0), F.lit(" bytes · "), cost, saved)


def status_label(status: Column, index: Column, total: Column) -> Column:
    at = F.concat((index + 1).cast("string"), F.lit(" of "), total.cast("string"))
    idle = F.when(total > 0, F.concat(total.cast("string"), F.lit(" sentences ready"))).otherwise("")
    out = F.when(status.isin("extracting", "error"), "").when(status == "buffering", "Buffering audio…")
    return out.when(status == "playing", F.concat(F.lit("Sentence "), at)).when(status == "paused", F.concat(F.lit("Paused · "), at)).otherwise(idle)


def nudge_speed(speed: Column, step: int) -> Column:
    """A step along the ladder from the rung at the speed, the next faster one, or the last."""
    rungs = F.array(*map(F.lit, SPEEDS))
    at = F.array_position(F.transform(rungs, lambda x: F.abs(x - speed) < 0.001), True)
    above = F.array_position(F.transform(rungs, lambda x: x >= speed), True)
    i = F.when(at > 0, at).when(above > 0, above).otherwise(len(SPEEDS)) - 1
    return F.get(rungs, clamp(i + step, 0, len(SPEEDS) - 1).cast("int"))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def file_title(url: Column) -> Column:
    """The decoded last part of a PDF's address."""
    name = F.split(F.element_at(F.split(url, "/"), -1), "\\?")[0]
    return F.try_url_decode(F.when(name == "", "PDF Document").otherwise(F.replace(name, F.lit("+"), F.lit("%2B"))))


def align_sentence(block_text: Column, spoken: Column) -> Column:
    """Where the first 40 characters of the spoken text stand in the block's, from 0; -1 if nowhere."""
    return F.instr(collapse(block_text), F.substring(display_text(spoken), 1, 40)) - 1
