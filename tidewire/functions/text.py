"""Text normalisation: whitespace, entities, HTML and Markdown to text."""

from __future__ import annotations

from functools import reduce

from functools import lru_cache
from html.entities import html5

from tidewire.functions.sql import case, each, keep, let, lit, sql_function

# Every character that counts as white space for trimming and collapsing.  The
# four separators U+001C..U+001F are not part of Java's Unicode white space.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


@sql_function
def strip(c: str) -> str:
    """Trim Unicode white space on both ends (SQL ``trim`` only knows U+0020)."""
    return f"btrim({c}, {lit(_SPACES)})"


@sql_function
def strip_chars(c: str, chars: str) -> str:
    return f"btrim({c}, {lit(chars)})"


def replaced(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(by)})"


def group1(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {lit(pattern)}, {group})"


def matches(c: str, pattern: str) -> str:
    return f"rlike({c}, {lit(pattern)})"


def single_blanks(c: str) -> str:
    return replaced(c, _SPACE_RUN, " ")


@sql_function
def squeeze(c: str) -> str:
    """Collapse runs of Unicode white space to one blank and trim."""
    return f"trim({single_blanks(c)})"


# --------------------------------------------------------------------------
# Character references
# --------------------------------------------------------------------------

# The HTML standard reads the numeric references of the C1 range as windows-1252;
# the five that it leaves undefined stay what they are.
_C1 = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))

_REFERENCE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"


@lru_cache(maxsize=1)
def _legacy_pattern() -> str:
    """Names that are also valid without a semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^&(" + "|".join(names) + ")"


# References seen in nearly all pages; they stand first in the table.
_FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "hellip;")


@lru_cache(maxsize=1)
def _names_text() -> str:
    """All named references as one text; much cheaper to ship with a plan than a map."""
    names = [*_FREQUENT, *(n for n in html5 if n not in _FREQUENT)]
    return "".join(f"\x01{name}\x02{html5[name]}" for name in names) + "\x01"


def _named(token: str) -> str:
    """The reference by its whole name, else by the longest name it begins with."""

    def value(names: str, name: str) -> str:
        mark = f"concat({lit(chr(1))}, {name}, {lit(chr(2))})"
        return let(
            f"instr({names}, {mark})",
            lambda at: case(
                (
                    f"{at} > 0",
                    f"substring_index(substr({names}, {at} + length({name}) + 2, 4), {lit(chr(1))}, 1)",
                )
            ),
        )

    def look_up(names: str) -> str:
        legacy = let(
            group1(token, _legacy_pattern()),
            lambda n: f"concat({value(names, n)}, substr({token}, length({n}) + 2))",
        )
        return f"coalesce({value(names, f'substr({token}, 2)')}, {legacy}, {token})"

    return let(lit(_names_text()), look_up)


def _character(code: str) -> str:
    point = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
    dropped = (
        f"{code} BETWEEN 1 AND 8 OR {code} BETWEEN 14 AND 31 OR {code} IN (11, 127)"
        f" OR {code} BETWEEN 64976 AND 65007 OR ({code} & 65534) = 65534"
    )
    return case(
        (f"{code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111", lit("\ufffd")),
        (f"{code} BETWEEN 128 AND 159", f"substr({lit(_C1)}, int({code} - 127), 1)"),
        (dropped, "''"),
        default=point,
    )


def _numeric(token: str) -> str:
    def value(digits: str, base: int) -> str:
        return let(
            f"ltrim('0', {digits})",
            lambda d: case(
                (f"{d} = ''", "0L"),
                (f"length({d}) > 7", "1114112L"),
                default=f"bigint(conv({d}, {base}, 10))",
            ),
        )

    code = let(
        group1(token, r"^&#([xX][0-9a-fA-F]+|[0-9]+)"),
        lambda d: case((matches(d, "^[xX]"), value(f"substr({d}, 2)", 16)), default=value(d, 10)),
    )
    return let(code, _character)


def _reference(token: str) -> str:
    return case(
        (f"NOT startswith({token}, '&') OR {token} = '&'", token),
        (f"{token} = '&amp;'", "'&'"),
        (f"startswith({token}, '&#')", _numeric(token)),
        default=_named(token),
    )


@sql_function
def unescape(c: str) -> str:
    """Replace HTML character references (all named ones and numeric ones).

    Texts without an ampersand skip the work.  The text is cut into references
    and the runs between them, so that a replaced reference is never read twice.
    """
    return let(
        c,
        lambda t: case(
            (f"NOT contains({t}, '&')", t),
            default=f"array_join({each(f'regexp_extract_all({t}, {lit(_REFERENCE)}, 0)', _reference)}, '')",
        ),
    )


# --------------------------------------------------------------------------
# HTML
# --------------------------------------------------------------------------

# Possessive, so that long tags neither recurse nor are tried again.
_ATTRS = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+"


def without_markup(c: str) -> str:
    """Drop comments, scripts and styles; put blanks where blocks start or end."""
    text = replaced(c, r"(?s)<!--.*?(?:-->|\z)", "")
    text = replaced(text, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    text = replaced(text, rf"(?i)</?(?:p|div|li)\b{_ATTRS}>|<br\b{_ATTRS}>", " ")
    return replaced(text, rf"<[/!?]?[A-Za-z]{_ATTRS}>", "")


@sql_function
def clean_html(c: str) -> str:
    """HTML to one line of text."""
    plain = let(c, lambda t: case((f"contains({t}, '<')", without_markup(t)), default=t))
    return squeeze(unescape(plain))


# Attribute syntax name="value" or name='value'.
_ATTRIBUTE = r"(?U)([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


@sql_function
def html_attributes(c: str) -> str:
    """``map<string,string>`` of quoted attributes; a repeated name keeps the last value."""

    def pair(a: str) -> str:
        name = f"lower({group1(a, r'^([^\s=]+)')})"
        value = unescape(group1(a, r"(?s)=\s*([\"'])(.*)\1$", 2))
        return f"named_struct('key', {name}, 'value', {value})"

    def as_map(pairs: str) -> str:
        return let(
            f"array_distinct({each(pairs, lambda p: f'{p}.key')})",
            lambda names: "map_from_arrays({0}, {1})".format(
                names,
                each(
                    names,
                    lambda n: f"element_at({keep(pairs, lambda p: f'{p}.key = {n}')}, -1).value",
                ),
            ),
        )

    return let(each(f"regexp_extract_all({c}, {lit(_ATTRIBUTE)}, 0)", pair), as_map)


@sql_function
def attribute(c: str, name: str) -> str:
    """Value of one attribute, ``''`` when absent."""
    return f"coalesce(try_element_at({html_attributes(c)}, {lit(name)}), '')"


# --------------------------------------------------------------------------
# Markdown
# --------------------------------------------------------------------------

# Markdown constructs.
IMAGE = r"!\[[^\]]*\]\([^\n)]*\)"
LINK = r"\[([^\]]+)\]\([^\n)]*\)"


@sql_function
def without_images(c: str) -> str:
    return replaced(c, IMAGE, " ")


def _unwrapped(c: str) -> str:
    """Link text instead of links, no emphasis marks."""
    return replaced(replaced(c, LINK, "$1"), "[`*_~]", "")


@sql_function
def markdown_text(c: str) -> str:
    """Markdown to one line of text: images, link targets, marks and tags go."""
    text = replaced(_unwrapped(without_images(c)), "<[^>]+>", " ")
    return strip(unescape(single_blanks(text)))


@sql_function
def markdown_body_text(c: str) -> str:
    """Same for the body of a card, where tags are cut before the Markdown."""
    text = replaced(replaced(c, r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")
    return strip(unescape(single_blanks(_unwrapped(without_images(text)))))


# What follows the label of a link or an image, and what else is cut from a fetched article.
_TARGETS = (r"\([^\n)]*\)", r"\[[^\]]*\]")
_IMAGE_TAG = r"(?is)<img\b[^>]*>"
_LINK_DEFINITION = r"(?dmU)^[ \t]*\[[^\]]+\]:[ \t]*[^\s\x1c-\x1f]+.*$"
_ADDRESSES = (r"<https?://[^>]+>", r"(?U)https?://[^\s\x1c-\x1f]+")
_SOURCE_LINE = r"(?dm)^[ \t]*URL Source:[ \t]*.*$"


@sql_function
def article_text(c: str, retain_links: bool = False) -> str:
    """Clean a fetched article: no images, and unless links are retained no targets or bare addresses.

    What one step leaves, the next one sees: a label may turn out to be a link itself.
    """
    steps = [(rf"!\[[^\]]*\]{target}", "") for target in _TARGETS] + [(_IMAGE_TAG, "")]
    if not retain_links:
        steps += [(rf"\[([^\]]+)\]{target}", "$1") for target in _TARGETS]
        steps += [(gone, "") for gone in (_LINK_DEFINITION, *_ADDRESSES)]
    steps += [(_SOURCE_LINE, ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
    return strip(reduce(lambda text, step: replaced(text, *step), steps, c))
