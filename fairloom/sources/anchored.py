"""The second site's detail pages: fields found behind their labels in the flattened text, as column expressions.

Paragraphs are taken out of a page in order, without markup. A value stands behind its label and ends where its own
form ends, so labels that follow without a gap don't become part of it. Each field has the first paragraph that holds
it; the four measures are taken from one paragraph together.

Defined results: a field that isn't found is null, year is 0 without a date; a null page has null fields and year 0.
A paragraph with a time in it, before the place is known, is read for dates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and forms of the pages.
SITE_SUFFIX = r"-中国会展网$"
HALLS = r"馆|中心|会展|广场|展览|展厅"
TIME = r"时间|日期"
RANGE = r"(\d{4}\.\d{2}\.\d{2})\s*-\s*(\d{4}\.\d{2}\.\d{2}|\d{2}\.\d{2})"
DAY = r"(\d{4}\.\d{2}\.\d{2})"
PLACE = r"^([一-鿿]+)-([一-鿿]+)\s+(.+)"
ORGANIZER = r"主办单位[：:](.+)"
MEASURES = {
    "area_str": (r"会展面积[：:]\s*([\d,]+平方米)", "面积:"),
    "exhibitors_str": (r"展商数量[：:]\s*([\d,]+家)", "展商:"),
    "visitors_str": (r"观众数量[：:]\s*([\d,]+人)", "观众:"),
    "cycle": (r"举办周期[：:]\s*(\d+年\d+届|年展|双年展|\S{1,4}?届)", ""),
}
ENGLISH = r"([A-Z][A-Za-z\s/&\-',]+(?:Expo|Exhibition|Fair|Show|Conference|Summit)[A-Za-z\s/&\-',0-9]*)"
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def flattened(c: Column) -> Column:
    """Text without markup; white space beside tags goes, as each piece of text is trimmed."""
    text = F.regexp_replace(c, r"(?s)\s*<!--.*?-->\s*|\s*<[^>]*>\s*", "")
    for name, sign in _ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


def paragraphs(page: Column) -> Column:
    each = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|\z)"), F.lit(1)), flattened)
    return F.filter(each, lambda t: t != "")


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def first_of(list_: Column, holds) -> Column:
    return F.get(F.filter(list_, holds), F.lit(0))


def anchored_fields(page: Column) -> dict[str, Column]:
    """Field name -> expression over a page's HTML."""
    heading = F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.regexp_replace(flattened(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), SITE_SUFFIX, "")
    has_heading = page.rlike(r"(?is)<h1[^>]*>.*?</h1>")
    every = F.coalesce(paragraphs(page), F.array().cast("array<string>"))
    numbered = F.transform(every, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    place = first_of(numbered, lambda x: x["t"].rlike(PLACE) & ~x["t"].rlike(TIME))
    known_from = F.coalesce(place["i"], F.lit(1 << 30))
    # a paragraph with a time is passed over until the place is known
    read = F.transform(F.filter(numbered, lambda x: ~(x["t"].rlike(TIME) & (x["i"] < known_from))), lambda x: x["t"])
    dated = first_of(every, lambda t: t.rlike(DAY))
    date = F.when(dated.rlike(RANGE), F.concat(matched(dated, RANGE, 1), F.lit(" - "), matched(dated, RANGE, 2))).otherwise(matched(dated, DAY))
    venue = F.trim(matched(place["t"], PLACE, 3))
    measured = first_of(read, lambda t: t.rlike("|".join(f"(?:{p})" for p, _ in MEASURES.values())))
    behind = F.regexp_extract(page, r"(?is)</h1>(.*?)(?=<(?:h[234]|table|div)[\s>]|\z)", 1)
    beside = F.slice(paragraphs(behind), 1, 6)
    english = F.regexp_replace(matched(F.array_join(F.when(has_heading & (F.size(beside) > 0), beside).otherwise(every), "\n"), ENGLISH), r"^\s+|\s+$", "")
    fields = {
        "cn_name": F.when(has_heading, flattened(heading)).otherwise(F.when(page.rlike("(?i)<title"), F.trim(title))),
        "en_name": F.when((F.char_length(english) > 8) & (F.char_length(english) < 100), english),
        "date_str": date,
        "city": matched(place["t"], PLACE, 2),
        "venue": F.when(venue.rlike(HALLS), venue),
        "organizer": F.trim(matched(first_of(read, lambda t: t.rlike(ORGANIZER)), ORGANIZER)),
    }
    fields |= {name: F.concat(F.lit(label), matched(measured, pattern)) for name, (pattern, label) in MEASURES.items()}
    return fields | {"year": F.coalesce(F.substring(date, 1, 4).cast("int"), F.lit(0))}


def anchored_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the fields of the second site's detail pages."""
    return pages.withColumns(anchored_fields(F.col(html)))
