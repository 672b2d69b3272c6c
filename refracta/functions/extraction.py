"""Links, code blocks and functions found inside larger texts, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.constants import BLOCK_CHARS, FUNCTION_CHARS, FUNCTION_WINDOW, LANGUAGE_ALIASES
from refracta.functions.text import WORD, WS, let, strip

# --- pages ------------------------------------------------------------------------

HEADLINE = rf"<h[23]\b[^>]*>(?:{WS}*<span[^>]*></span>)?{WS}*<span[^>]*mw-headline"


def unescape(text: Column) -> Column:
    """The entities that occur in code listings; ``&amp;`` last so nothing is undone twice."""
    for entity, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&nbsp;", " "),
        ("&#160;", " "),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_links(html: Column, prefix: str = "/wiki/", base_url: str = "") -> Column:
    """Absolute links of a page in order of first appearance.

    Kept are anchors below ``prefix`` without a colon; the prefix itself is not one.
    """
    hrefs = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    wanted = F.filter(
        hrefs,
        lambda h: F.startswith(h, F.lit(prefix)) & ~F.contains(h, F.lit(":")) & (h != prefix),
    )
    return F.array_distinct(F.transform(wanted, lambda h: F.concat(F.lit(base_url), unescape(h))))


def sections(html: Column, heading: str = HEADLINE) -> Column:
    """The page cut before every heading; text in front of the first one comes first."""
    return F.split(html, rf"(?i)(?={heading})")


def headline_id(section: Column) -> Column:
    """Id of the headline that opens a section, '' when it has none."""
    span = F.regexp_extract(section, r"(?i)<span[^>]*mw-headline[^>]*>", 0)
    return F.regexp_extract(span, r'\bid="([^"]*)"', 1)


def first_block(section: Column, tags=("pre", "code"), limits=BLOCK_CHARS, closed: bool = True) -> Column:
    """Text of the first block whose length lies within the limits, else NULL.

    Unless only ``closed`` blocks count, one without end tag ends with the section. A ``<`` in
    front of anything but a letter, ``/`` or ``!`` is text.
    """
    end = "" if closed else r"|\z"
    inner = F.regexp_extract_all(
        section, F.lit(rf"(?is)<({'|'.join(tags)})\b[^>]*>(.*?)(?:</\1>{end})"), F.lit(2)
    )
    texts = F.transform(inner, lambda b: strip(unescape(F.regexp_replace(b, r"</?[A-Za-z!][^>]*>", ""))))
    fitting = F.filter(texts, lambda t: F.length(t).between(*limits))
    return F.get(fitting, F.lit(0))


# Elements without an end tag, and what ends an open element of the same place.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_BLOCKS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)
_ENDED_BY = {
    "p": _BLOCKS, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",),
}
# A comment, a script or style with its raw content, a tag, a lone "<", or text.
_TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|</?[a-z][^>]*>|<|[^<]+"


def first_sibling_holding(html: Column, tags=("pre", "code")) -> Column:
    """First element at the outermost level that has one of the tags inside it, else NULL.

    The element's own tag does not count. Open elements are kept by name, innermost first. An
    end tag closes everything up to the last open element of its name, and nothing when there
    is none; so crossed tags end with the outer one. Paragraphs, list items, cells and rows
    end where the next one begins, other elements that are never closed at the end of the text.
    """
    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    start = F.struct(
        F.array().cast("array<string>").alias("open"),
        *[F.lit(0).alias(n) for n in ("pos", "start", "from", "to")],
        F.lit(False).alias("holds"),
    )
    ended = F.create_map(*[x for name, by in _ENDED_BY.items() for x in (F.lit(name), F.array(*[F.lit(b) for b in by]))])

    def step(s: Column, t: Column) -> Column:
        raw = F.rlike(t, F.lit(r"(?i)^<(?:!--|script|style)"))
        name = F.when(~raw, F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1)))
        return let(name, lambda n: followed(s, t, n))

    def followed(s: Column, t: Column, name: Column) -> Column:
        tag = F.coalesce(name != "", F.lit(False))
        closes = tag & F.startswith(t, F.lit("</"))
        alone = name.isin(*_VOID) | F.endswith(t, F.lit("/>"))
        opens = tag & ~closes
        depth = F.size(s["open"])
        # An open element that this start tag ends, or the one that this end tag names.
        implied = opens & F.coalesce(F.array_contains(ended[F.get(s["open"], F.lit(0))], name), F.lit(False))
        level = F.when(closes, F.array_position(s["open"], name).cast("int")).when(implied, 1).otherwise(0)
        left = F.slice(s["open"], level + 1, F.greatest(depth - level, F.lit(0)))
        after = F.when(opens & ~alone, F.concat(F.array(name), left)).otherwise(left)
        begins = opens & ~alone & (F.size(left) == 0)
        pos = s["pos"] + F.length(t)
        ends = (level > 0) & (F.size(left) == 0) & s["holds"] & (s["to"] == 0)
        inside = s["holds"] | (opens & (F.size(left) > 0) & name.isin(*tags))
        return F.struct(
            after.alias("open"),
            pos.alias("pos"),
            F.when(begins, s["pos"]).otherwise(s["start"]).alias("start"),
            F.when(ends, s["start"]).otherwise(s["from"]).alias("from"),
            F.when(ends, F.when(closes, pos).otherwise(s["pos"])).otherwise(s["to"]).alias("to"),
            F.when(begins, False).otherwise(inside).alias("holds"),
        )

    def finish(s: Column) -> Column:
        unclosed = (F.size(s["open"]) > 0) & s["holds"]
        return F.when(s["to"] > 0, F.substring(html, s["from"] + 1, s["to"] - s["from"])).when(
            unclosed, F.substring(html, s["start"] + 1, s["pos"] - s["start"])
        )

    return F.aggregate(tokens, start, step, finish)


def section_listing(section: Column, tags=("pre", "code"), limits=BLOCK_CHARS) -> Column:
    """First fitting block of the first element below the heading that has any block."""
    below = F.regexp_replace(section, r"(?is)\A<h([23])\b.*?</h\1>", "")
    return let(below, lambda x: first_block(first_sibling_holding(x, tags), tags, limits, closed=False))


def language_blocks(html: Column, heading: str = HEADLINE, tags=("pre", "code")) -> Column:
    """One (alias, language, code) per known language heading, first section each."""
    parts = F.transform(
        sections(html, heading), lambda s: F.struct(headline_id(s).alias("alias"), s.alias("body"))
    )

    def body_of(p: Column, alias: str) -> Column:
        return F.get(F.filter(p, lambda x: x["alias"] == alias), F.lit(0))["body"]

    def listings(p: Column) -> Column:
        found = [
            F.struct(
                F.lit(alias).alias("alias"),
                F.lit(language).alias("language"),
                section_listing(body_of(p, alias), tags).alias("code"),
            )
            for alias, language in LANGUAGE_ALIASES.items()
        ]
        return F.filter(F.array(*found), lambda b: b["code"].isNotNull())

    return let(parts, listings)


# --- source files -------------------------------------------------------------------

# Header patterns. Group 1 is the name. A match starts where its first run (whitespace
# or token) starts: a start inside the run could only repeat the same attempt, and long
# runs would cost quadratic time. So the leftmost match of a header is also its first
# literal occurrence behind the previous match. The possessive whitespace run bounds
# the JVM's regex recursion.
_PARAMS = rf"{WS}*\([^)]*\){WS}*"
_MODIFIERS = "public|private|protected|static"
_TYPE = r"\p{L}\p{N}_<>"
JAVA_HEADER = (
    rf"(?:(?<!{WS}){WS}++|{_MODIFIERS})(?:{WS}++|{_MODIFIERS})*"
    rf"[{_TYPE}\[\]]+{WS}+({WORD}+){_PARAMS}\{{"
)
JS_FUNCTION_HEADER = rf"function{WS}+({WORD}+){_PARAMS}\{{"
JS_ARROW_HEADER = rf"const{WS}+({WORD}+){WS}*={_PARAMS}=>{WS}*\{{"
CPP_HEADER = rf"(?<![{_TYPE}:*&])[{_TYPE}:*&]+{WS}+({WORD}+){_PARAMS}\{{"
HEADERS = {
    "java": (JAVA_HEADER,),
    "javascript": (JS_FUNCTION_HEADER, JS_ARROW_HEADER),
    "cpp": (CPP_HEADER,),
}


#: Most functions end within so many characters; only the others are followed any further.
_NEAR = 512
#: So many headers in a row are longer than a function window, since the shortest has six characters.
HEADERS_IN_WINDOW = FUNCTION_WINDOW // 6 + 1


def _closed_at(text: Column) -> Column:
    """Length of the text up to the brace that first returns to depth 0, 0 if none does."""
    pieces = F.split(text, r"\}")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        # a piece ends at a closing brace
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = s["depth"] + opened - 1
        pos = s["pos"] + F.length(piece) + 1
        return F.when(s["end"] > 0, s).otherwise(
            F.struct(depth.alias("depth"), pos.alias("pos"), F.when(depth == 0, pos).otherwise(0).alias("end"))
        )

    # what follows the last closing brace is not a piece
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["end"])


def balanced_prefix(text: Column) -> Column:
    """Text up to the brace that first returns to depth 0; all of it if none does."""

    def cut(end: Column, otherwise: Column) -> Column:
        return F.when(end > 0, F.left(text, end)).otherwise(otherwise)

    whole = let(_closed_at(text), lambda end: cut(end, text))
    return let(_closed_at(F.left(text, F.lit(_NEAR))), lambda end: cut(end, whole))


def brace_functions(code: Column, header: str) -> Column:
    """Array of (name, code) for every header match, cut at the balancing brace.

    The text is cut once at its headers. A function that ends before the next header needs its
    own part only; for the others the parts behind are joined, up to the window.
    """
    headers = F.regexp_extract_all(code, F.lit(header), F.lit(0))
    between = F.split(code, header)
    parts = F.zip_with(headers, F.slice(between, F.lit(2), F.size(between)), lambda h, p: F.concat(h, p))

    def functions(p: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            own = F.left(p["parts"][i], F.lit(FUNCTION_WINDOW))
            following = F.slice(p["parts"], i + 1, F.lit(HEADERS_IN_WINDOW))
            window = F.left(F.array_join(following, ""), F.lit(FUNCTION_WINDOW))
            near = F.left(own, F.lit(_NEAR))
            text = let(
                _closed_at(near),
                lambda end: F.when(end > 0, F.left(near, end)).otherwise(let(window, balanced_prefix)),
            )
            return F.struct(F.regexp_extract(h, header, 1).alias("name"), text.alias("code"))

        return F.transform(p["headers"], one)

    found = let(F.struct(headers.alias("headers"), parts.alias("parts")), functions)
    return F.filter(found, lambda f: F.length(f["code"]).between(*FUNCTION_CHARS))


def language_functions(code: Column, language: str) -> Column:
    """All functions of one brace language in the order they are reported."""
    found = [brace_functions(code, h) for h in HEADERS[language]]
    return found[0] if len(found) == 1 else F.concat(*found)
