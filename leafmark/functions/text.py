"""Text expressions.  All are Catalyst column expressions; regular expressions spell out
the white space of Unicode, which `\\s` and `trim` do not cover."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark import profiles

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+\z"
#: What each text key leaves out.
KEYS = {
    "dedup": rf"[{SPACE}\x{{200b}}\-_~\x{{2665}}\x{{2661}}!\x{{ff01}}?\x{{ff1f}}\x{{30fc}}\x{{2014}}\x{{2015}}]+",
    "squeezed": rf"[{SPACE}\x{{200b}}]+",
    "plain": rf"[{SPACE}]+",
}
KANJI = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
KANA_ONLY = r"^[\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{20}\x{3000}\x{2026}\x{2025}\x{30fb}]+\z"
#: The punctuation rules, in their order.
PUNCTUATION = (
    (r"[ ]*!!+", "‼"),
    (r"[ ]*\?\?+", "⁇"),
    (r"[ ]*\.\.+", "…"),
    (r"[ ]*(!\?)+", "⁉"),
    (r"[ ]*(\?!)+", "⁈"),
    (r"[ ]*…+", "…"),
    (r"[ ]*[・･]{2,}", "…"),
    (r"[ ]*·{2,}", "…"),
    (r"[ ]*-+", "ー"),
    (r"[ ]*–+", "―"),
    (r"[ ]*:+[ ]*", "…"),
    (r"^[!?:]+\z", ""),
    (r"([⁉⁈‼⁇])[!?:]+", "$1"),
    (r"[!?:]+([⁉⁈‼⁇])", "$1"),
    (r" ", ""),
)


def compiled(pattern: str) -> re.Pattern[str]:
    """One of the patterns above for use in Python."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern).replace(r"\z", r"\Z"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def key(text: Column, kind: str) -> Column:
    """The text without the characters that comparisons of this kind ignore."""
    return F.regexp_replace(text, KEYS[kind], "")


def has_kanji(text: Column) -> Column:
    return text.rlike(KANJI)


def is_pure_kana(text: Column) -> Column:
    return text.rlike(KANA_ONLY)


def _any_of(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "~?!" else m for m in marks) + "]"


def has_dialogue_mark(text: Column) -> Column:
    return text.rlike(_any_of(profiles.DIALOGUE_MARKS))


def has_line_mark(text: Column) -> Column:
    return text.rlike(_any_of(profiles.LINE_MARKS))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*\z")


def one_holds_other(a: Column, b: Column) -> Column:
    """One text is part of the other and neither is empty."""
    return (F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) > 0)


#: Of each punctuation rule, strings of which a text that it changes has one (none: any may).
_NEEDED = (
    ("!!",), ("??",), ("..",), ("!?",), ("?!",), ("…",), ("・・", "・･", "･・", "･･"), ("··",), ("-",), ("–",), (":",), (), tuple("⁉⁈‼⁇"), tuple("⁉⁈‼⁇"), (" ",),
)


def _rule(pattern: str, replacement: str, needed: tuple[str, ...]) -> Callable[[Column], Column]:
    def changed(t: Column) -> Column:
        new = F.replace(t, F.lit(pattern), F.lit(replacement)) if pattern == " " else F.regexp_replace(t, pattern, replacement)
        return F.when(reduce(or_, (F.contains(t, F.lit(n)) for n in needed)), new).otherwise(t) if needed else new

    return changed


def clean_punctuation(text: Column) -> Column:
    """The punctuation rules one after another; a rule's regular expression runs only on
    texts that hold what it needs.  A null text stays null."""
    for (pattern, replacement), needed in zip(PUNCTUATION, _NEEDED, strict=True):
        # The lambda names the text so far, so that it is worked out once for test and change.
        text = F.transform(F.array(text), _rule(pattern, replacement, needed))[0]
    return text


def separator(name: Column) -> Column:
    """The characters that a word separator stands for."""
    return F.when(name == "SPACE", " ").when(name == "NEWLINE", "\n").when(name == "TEXT_SEPARATOR_UNSPECIFIED", "").otherwise(F.coalesce(name, F.lit("")))


def to_display(text: Column) -> Column:
    """Joins between merged lines as line breaks."""
    return F.replace(text, F.lit("​"), F.lit("\n"))


def to_saved(text: Column) -> Column:
    """Line breaks (each run of them) as joins between merged lines."""
    return F.regexp_replace(text, "\n+", "​")


def url_part(value: Column) -> Column:
    """A value percent-encoded for a URL's query, but for letters, digits and -_.!~*'()."""
    encoded = F.url_encode(value)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return encoded


def request_url(server: Column, url: Column, context: Column) -> Column:
    """The request for a page's text: its URL without query string, and the context."""
    return F.concat(server, F.lit("/ocr?url="), url_part(bare_url(url)), F.lit("&context="), url_part(context))


def bare_url(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def is_page_url(url: Column) -> Column:
    return F.contains(url, F.lit("/api/v1/manga/")) & F.contains(url, F.lit("/page/")) & ~F.contains(url, F.lit("/thumbnail"))


def chapter_of(url: Column) -> Column:
    """`/manga/N/chapter/N`, or null."""
    found = F.regexp_extract(url, r"/manga/[0-9]+/chapter/[0-9]+", 0)
    return F.when(found != "", found)


def page_number(url: Column) -> Column:
    """The number after `page/`, or -1."""
    found = F.regexp_extract(url, r"page/([0-9]+)", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.lit(-1).cast("long"))


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8")))


def site_rule(row: Column) -> Column:
    """A `pattern; selector; ...; container` row: first, middle and last part, trimmed."""
    parts = F.transform(F.split(row, ";"), lambda p: strip(p))
    n = F.size(parts)
    return F.struct(
        parts[0].alias("pattern"), F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("selectors"), F.element_at(parts, -1).alias("container")
    )
