"""Extraction from HTML, scripts and JSON."""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Patterns of the pages that are read.
IMAGE_ARRAY = r"var\s+imgArr\s*=\s*(\[[^;]*\])\s*;"
ERA, YEAR = r"시\s*대\s*[:]?\s*(\S+)", r"제작연도\s*[:]?\s*([^\n]+)"
STOPS, HEADING = ["시대", "제작연도", "◆"], r"^\d{2}$"


def tag_texts(c: Column, tag: str) -> Column:
    """Inner HTML of every element of a tag that doesn't nest, in order."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def attributes(c: Column, tag: str, name: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf'<{tag}\s[^>]*?{name}="([^"]*)"'), F.lit(1))


def decoded(c: Column) -> Column:
    """Character references as characters: all names of HTML that end in a semicolon, decimal and hexadecimal numbers; others stay as they are.

    Each reference is decoded once, from left to right, so that `&amp;lt;` gives `&lt;`.
    """
    common = ["amp;", "lt;", "gt;", "quot;", "nbsp;"]  # a map is searched from its start
    names = F.create_map(*[F.lit(x) for name in [*common, *(n for n in html5 if n not in common)] if name.endswith(";") for x in (name[:-1], html5[name])])

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).try_cast("int")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        ch = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(F.when(code.isNotNull(), F.lit("\ufffd")))
        found = F.coalesce(ch, F.try_element_at(names, name))
        return F.when(found.isNotNull(), F.concat(found, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))).otherwise(c)


def visible_text(c: Column) -> Column:
    """Text outside of tags, scripts, styles and comments, on one line."""
    x = F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.replace(decoded(F.regexp_replace(x, "<[^>]*>", " ")), F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\n]+", " "))


def json_array(c: Column, pattern: str = IMAGE_ARRAY) -> Column:
    """Array of strings that a script assigns; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), "array<string>")


def unquoted_arguments(c: Column) -> Column:
    """Arguments of a call, split at commas, without quotes around them."""
    return F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))


def heading(lines: Column, cjk: str) -> Column:
    """struct(number, name, hanja) of the entry that a page's lines open, or null.

    The first line of two digits among the first ten; then up to four lines until a
    stop word: those of more than 70 % CJK characters are the hanja name.
    """
    from ..functions.text import cjk_ratio

    trimmed = F.transform(lines, lambda x: F.trim(x))
    at = F.array_position(F.transform(F.slice(trimmed, 1, 10), lambda x: x.rlike(HEADING)), True)
    after = F.slice(trimmed, (at + 1).cast("int"), F.lit(4))
    stop = F.array_position(F.transform(after, lambda x: x.rlike("|".join(STOPS))), True)
    names = F.filter(F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after), lambda x: x != "")
    hanja = F.filter(names, lambda x: cjk_ratio(x, cjk) > 0.7)
    name = F.filter(names, lambda x: cjk_ratio(x, cjk) <= 0.7)
    return F.when(at > 0, F.struct(F.element_at(trimmed, F.greatest(at, F.lit(1)).cast("int")).alias("number"), F.array_join(name, " ").alias("name"), F.nullif(F.array_join(hanja, " "), F.lit("")).alias("hanja")))


def metadata(lines: Column) -> Column:
    """struct(era, year) from a page's lines."""
    from ..functions.text import first_group

    all_ = F.array_join(lines, " ")
    year = F.split_part(F.split_part(first_group(all_, YEAR), F.lit("소재지"), F.lit(1)), F.lit("◆"), F.lit(1))
    return F.struct(first_group(all_, ERA).alias("era"), F.trim(year).alias("year"))


def contains_dispatch(key: Column, value: Column, position: Column, column: str, words: list[str], others: list[str]) -> Column:
    """The last value whose key holds one of `words` and none of `others` that come before: one column of a pivot."""
    own = key.rlike("|".join(words)) & ~(key.rlike("|".join(others)) if others else F.lit(False))
    return F.max_by(F.when(own, value), F.when(own, position)).alias(column)


def register_udtfs() -> dict:
    """Table functions for nested documents, made when a session is there."""

    @udtf(returnType="tag string, depth int, text string")
    class NestedText:
        """Elements with their depth and own text, from nested HTML."""

        def eval(self, source: str):
            rows, stack = [], []

            class Reader(HTMLParser):
                def handle_starttag(self, tag, attrs):
                    if tag not in ("br", "hr", "img", "meta", "link", "input"):
                        stack.append([tag, []])

                def handle_endtag(self, tag):
                    if any(x[0] == tag for x in stack):
                        while True:
                            name, parts = stack.pop()
                            rows.append((name, len(stack), " ".join("".join(parts).split())))
                            if name == tag:
                                break

                def handle_data(self, data):
                    if stack:
                        stack[-1][1].append(data)

            Reader(convert_charrefs=True).feed(source or "")
            yield from rows

    @udtf(returnType="ordinal int, text string")
    class JsonTexts:
        """Every `text` of a JSON document: an object's own first, then its children in the order of their keys."""

        def eval(self, source: str):
            import json

            found = []

            try:
                document = json.loads(source)
            except (TypeError, ValueError, RecursionError):
                return
            left = [document]
            while left:
                x = left.pop()
                if isinstance(x, dict):
                    if isinstance(x.get("text"), str):
                        found.append(x["text"])
                    left += [v for k, v in x.items() if k != "text" or not isinstance(v, str)][::-1]
                elif isinstance(x, list):
                    left += x[::-1]
            for k, x in enumerate(found or [json.dumps(document, ensure_ascii=False)]):
                yield k, x.replace("\n", "")

    return {"NestedText": NestedText, "JsonTexts": JsonTexts}
