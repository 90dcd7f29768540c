"""Article lists embedded as JSON in the scripts of a page.

Spark's JSON parser reads the value at the beginning of a text and leaves the rest alone.  So a list at any depth is
found by the place of its name: the text from there on is parsed, and what is parsed is the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import page_date, page_date_parts
from tidewire.functions.sql import case, each, fold, keep, let, lit
from tidewire.functions.text import clean_html, strip
from tidewire.functions.urls import canonical_url, issue_url, item_link
from tidewire.sources.landing import DOC, entry_rows

# Where pages keep their article lists.
LIST_NAME = "articleList"
DATA_SCRIPT = "__NEXT_DATA__"
PUSH_CALL = "self.__next_f.push("

_COMMENT_OR_SCRIPT = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)"
_PARTS = r"(?is)^<script\b([^>]*)>(.*?)(?:</script\s*>|\z)"
_IS_DATA = rf"(?i)(?:^|\s)id\s*=\s*([\"']?){DATA_SCRIPT}\1(?:\s|/|$)"
_STRING = r"\"(?:[^\"\\]++|\\.)*+\""
#: A call with an argument that may be JSON, which has no parentheses outside of strings.
_CALL = rf"(?s)\Q{PUSH_CALL}\E((?:[^\"'()]++|{_STRING}|'(?:[^'\\]++|\\.)*+')*+)\)"
#: Text up to a place behind the name of a list: in JSON, and in text that JSON strings hold.  Each search begins where
#: the last one ended and nowhere else, so a text is read once.
_TO_LIST = rf"(?s)\G.*?\"{LIST_NAME}\"\s*+:\s*+"
_TO_LIST_IN_TEXT = rf"(?s)\G.*?[\"']{LIST_NAME}[\"']\s*+:\s*+"
_EMPTY_JSON = ('""', "0", "0.0", "-0", "-0.0", "false", "null", "[]", "{}")


def _scripts(text: str) -> str:
    """Script elements in order, of pages that name a place for lists; those in comments are none."""
    found = keep(f"regexp_extract_all({text}, {lit(_COMMENT_OR_SCRIPT)}, 0)", lambda e: f"NOT startswith({e}, '<!')")
    return case((f"contains({text}, {lit(DATA_SCRIPT)}) OR contains({text}, {lit(PUSH_CALL)})", found))


def _is_json(text: str) -> str:
    """Whether all of a text is one JSON value: with another value behind it, it is the first one of two."""
    two = f"try_variant_get(try_parse_json(concat('[', {text}, ',\"end\"]')), '$', 'array<variant>')"
    return let(two, lambda v: f"coalesce(size({v}) = 2 AND to_json(get({v}, 1)) = '\"end\"', false)")


def _values(script: str) -> str:
    """JSON texts of a script, with whether they are arguments of a call."""
    code = f"regexp_extract({script}, {lit(_PARTS)}, 2)"
    named = f"regexp_extract({script}, {lit(_PARTS)}, 1) RLIKE {lit(_IS_DATA)}"
    calls = f"regexp_extract_all({code}, {lit(_CALL)}, 1)"
    data = f"if({named}, array(named_struct('json', {code}, 'pushed', false)), array())"
    return f"concat({data}, {each(calls, lambda a: f'named_struct({lit("json")}, {a}, {lit("pushed")}, true)')})"


def _strings(json: str) -> str:
    """All strings of a JSON text that are no names, in order."""
    tokens = f"regexp_extract_all({json}, {lit(f'(?s){_STRING}(?:{chr(92)}s*+:)?+')}, 0)"
    values = keep(tokens, lambda t: f"endswith({t}, {lit(chr(34))})")
    return each(values, lambda t: f"coalesce(try_variant_get(try_parse_json({t}), '$', 'string'), '')")


def _lists(text: str, to_list: str) -> str:
    """Entries, as JSON, of each list that is named in a text."""

    def entries(place: str) -> str:
        value = f"try_parse_json(substring({text}, {place}))"
        items = let(
            value,
            lambda v: f"coalesce(try_variant_get({v}, '$', 'array<variant>'), try_variant_get({v}, '$.items', 'array<variant>'))",
        )
        return each(items, lambda e: f"to_json({e})")

    ways = f"regexp_extract_all({text}, {lit(to_list)}, 0)"
    places = fold(
        ways, "array(bigint(1))", lambda done, way: f"array_append({done}, element_at({done}, -1) + length({way}))"
    )
    return keep(each(f"slice({places}, 2, size({ways}))", entries), lambda e: f"{e} IS NOT NULL")


def _member(name: str) -> str:
    return f"try_variant_get(v, '$.{name}', 'variant')"


def _truthy(value: str) -> str:
    empty = ", ".join(lit(e) for e in _EMPTY_JSON)
    return f"coalesce(to_json({value}) NOT IN ({empty}), false)"


def _first_of(*names: str) -> str:
    """The first non-empty alternative, else whatever the last one holds."""
    *others, last = (_member(name) for name in names)
    return "coalesce({}, {})".format(", ".join(f"if({_truthy(o)}, {o}, NULL)" for o in others), last)


def _is_string(value: str) -> str:
    return f"coalesce(schema_of_variant({value}) = 'STRING', false)"


def _string(value: str) -> str:
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def _as_text(name: str) -> str:
    value = _member(name)
    return case(
        (f"NOT {_truthy(value)}", "''"),
        (_is_string(value), _string(value)),
        (f"schema_of_variant({value}) = 'BOOLEAN'", "'True'"),
        default=f"to_json({value})",
    )


def _found(docs: DataFrame) -> DataFrame:
    """Add ``found``: the entries of all lists of a page as JSON, NULL without a list.

    Lists in JSON come first, in the order of scripts, then those in strings of calls; one list can be inside a
    string or go on over several of them.
    """
    values = f"flatten({each('scripts', _values)})"
    pieces = f"flatten({each('filter(texts, t -> t.pushed)', lambda v: _strings(f'{v}.json'))})"
    in_json = f"flatten({each('texts', lambda v: _lists(f'{v}.json', _TO_LIST))})"
    in_text = f"flatten({each('array_append(pieces, array_join(pieces, ' + lit('') + '))', lambda p: _lists(p, _TO_LIST_IN_TEXT))})"
    return (
        docs.withColumn("scripts", F.expr(f"CASE WHEN source_error IS NULL THEN {_scripts('text')} END"))
        .withColumn("texts", F.expr(keep(values, lambda v: _is_json(f"{v}.json"))))
        .withColumn("pieces", F.expr(pieces))
        .withColumn("lists", F.expr(f"concat({in_json}, {in_text})"))
        .withColumn("found", F.expr("if(size(lists) > 0, flatten(lists), NULL)"))
        .select(*DOC, "source_error", "found")
    )


def embedded_json_entries(docs: DataFrame) -> DataFrame:
    missing = "invalid Next.js index: articleList.items was not found"
    found = _found(docs)
    rows = (
        found.withColumn(
            "source_error", F.expr(f"coalesce(source_error, CASE WHEN found IS NULL THEN {lit(missing)} END)")
        )
        .select(
            *DOC,
            "source_error",
            # The same entry often comes twice; its first place counts.
            F.expr(
                "posexplode_outer(if(source_error IS NULL,"
                " slice(array_distinct(found), 1, window_size), NULL))"
            ).alias("index", "json"),
        )
        # A list without entries is neither a failure nor an entry.
        .where("source_error IS NOT NULL OR json IS NOT NULL")
        .selectExpr(*DOC, "source_error", "index + 1 AS pos", "json", "try_parse_json(json) AS v")
        .selectExpr(
            *DOC,
            "pos",
            "source_error",
            "startswith(json, '{') AS is_object",
            f"{_member('title')} AS title_v",
            f"{_first_of('href', 'url', 'link')} AS href_v",
            f"{_first_of('date', 'publishedAt', 'published_at')} AS date_v",
            f"{strip(_as_text('id'))} AS id",
            f"{clean_html(_as_text('description'))} AS content",
        )
        .selectExpr(
            *DOC,
            "pos",
            "source_error",
            "is_object",
            "id",
            "content",
            f"{_is_string('title_v')} AS title_ok",
            f"{_is_string('href_v')} AS href_ok",
            f"{_is_string('date_v')} AS date_ok",
            f"{page_date(page_date_parts(_string('date_v')))} AS published",
            f"{_string('title_v')} AS raw_title",
            f"{_string('href_v')} AS raw_url",
        )
        .withColumn("typed", F.expr("title_ok AND href_ok AND date_ok"))
        .withColumn("title", F.expr(f"if(typed, {clean_html('raw_title')}, '')"))
        .withColumn("raw_url", F.expr("if(typed, raw_url, '')"))
        .withColumn("checked", F.expr(item_link("raw_url", "page_url", "allowed_hosts")))
    )
    error = case(
        ("source_error IS NOT NULL", "NULL"),
        ("NOT is_object", "'articleList item must be an object'"),
        ("NOT title_ok", "'articleList item title must be a string'"),
        ("NOT href_ok", "'articleList item href must be a string'"),
        ("NOT date_ok", "'articleList item date must be a string'"),
        ("title = ''", "'articleList item is missing title'"),
        ("raw_url = ''", "'articleList item is missing href'"),
        ("published IS NULL", "'invalid page publication date'"),
        ("published = ''", "'articleList item has an invalid date'"),
        default="checked.error",
    )
    return entry_rows(
        rows,
        error=error,
        issue_title="title",
        issue_url=f"if(is_object, {issue_url('page_url', 'raw_url')}, '')",
        item_id=f"if(id <> '', id, {canonical_url('checked.url')})",
        title="title",
        content="content",
        url="checked.url",
        published_at="published",
        category="'Research'",
    )
