"""The tree of fair categories: from pages' links, with its closure, and as JSON files.

A link's path names its place: /exhibition-12-... is category 12, /exhibition-12-34-... category 34 below it. Links and
options are read by patterns, without a parser. The closure of any parent table is found by doubling jumps: after k
rounds every node knows its ancestors up to 2 ** k levels up, so a tree of depth d takes log2(d) joins. Nodes on a cycle
or below one are refused and listed, as are nodes whose parent isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.operators.leaders import numbered_in_order
from fairloom.operators.relational import latest_per_key
from fairloom.operators.storage import cut
from fairloom.sources.anchored import flattened

PATH = r"/exhibition-(\d+)"
_ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"']*/exhibition-[^"']*)["'][^>]*>(.*?)</a>"""
_OPTION = r"""(?is)<option\s[^>]*?value=["']([^"']*/exhibition-[^"']*)["'][^>]*>(.*?)(?=</option>|<option|</select>|\z)"""

PARENT = "name string, url string, parent_id string"
CHILD = "name string, sub_id string, parent_id string"
FILE = f"parent_categories array<struct<{PARENT.replace(' string', ':string')}>>, subcategories array<struct<{CHILD.replace(' string', ':string')}>>, crawled_at string"


def _linked(page: Column, pattern: str) -> Column:
    """href, name of links in page order, both filled."""
    pairs = F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)).alias("href"), F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(2)), flattened).alias("name"))
    return F.filter(pairs, lambda p: (p["href"] != "") & (p["name"] != ""))


def category_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with at, href, name of each category link; options count where a page has no such anchor."""
    anchors = _linked(F.col(html), _ANCHOR)
    each = F.when(F.size(anchors) > 0, anchors).otherwise(_linked(F.col(html), _OPTION))
    return pages.select("*", F.posexplode(each).alias("at", "link_")).select(*pages.columns, "at", "link_.href", "link_.name")


def parent_categories(pages: DataFrame, base_url: str, html: str = "html", url: str = "url") -> DataFrame:
    """name, url, parent_id of the categories a site's front pages link to: the first link to each address."""
    links = category_links(pages.select(url, html), html)
    full = F.when(F.col("href").startswith("/"), F.concat(F.lit(base_url), "href")).otherwise(F.col("href"))
    rows = links.select(F.col(url).alias("from_"), "at", "name", full.alias("url"), F.coalesce(F.nullif(F.regexp_extract("href", PATH, 1), F.lit("")), F.lit("0")).alias("parent_id"))
    return latest_per_key(rows, ["url"], [F.col("from_"), F.col("at")]).select("name", "url", "parent_id")


def subcategories(pages: DataFrame, html: str = "html", url: str = "url", parent_id: str = "parent_id") -> DataFrame:
    """name, sub_id, parent_id of what parents' pages link to below them: the first link to each. Options are looked at
    where no anchor of a page leads below its category."""

    def below(pattern: str) -> Column:
        found = _linked(F.col(html), pattern)
        start = F.concat(F.lit(PATH.replace(r"(\d+)", "")), F.col(parent_id), F.lit(r"-(\d+)"))
        kept = F.filter(found, lambda p: F.regexp_like(p["href"], start))
        return F.transform(kept, lambda p: F.struct(F.regexp_extract(p["href"], r"/exhibition-\d+-(\d+)", 1).alias("sub_id"), p["name"].alias("name")))

    anchors = below(_ANCHOR)
    each = F.when(F.size(anchors) > 0, anchors).otherwise(below(_OPTION))
    found = pages.where(F.col(parent_id).isNotNull()).select(F.col(url).alias("from_"), F.col(parent_id).alias("of_"), each.alias("each_"))
    rows = found.select("from_", F.col("of_").alias("parent_id"), F.posexplode("each_").alias("at", "s"))
    return latest_per_key(rows.select("from_", "parent_id", "at", "s.*"), ["parent_id", "sub_id"], [F.col("from_"), F.col("at")]).select("name", "sub_id", "parent_id")


def ancestors(nodes: DataFrame, node: str = "node", parent: str = "parent", max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """The closure (node, ancestor, distance from 1) of a parent table, and what is refused (node, reason): 'orphan' if
    the parent isn't a node, 'cycle' if the way up never ends. An orphan's descendants keep it as their top. Nodes
    without a parent are tops. A node given twice counts with its smallest parent."""
    rows = cut(nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent")))
    there = rows.select(F.col("node").alias("parent"))
    orphans = rows.where("parent is not null").join(there, "parent", "left_anti").select("node", F.lit("orphan").alias("reason"))
    jump = rows.join(there, "parent").select("node", F.col("parent").alias("ancestor"))
    reach = jump.withColumn("distance", F.lit(1))
    jump, reach = cut(jump), cut(reach)
    step = 1
    looped = cut(rows.select("node").limit(0))
    for _ in range(max_rounds):
        on_cycle = reach.where("node = ancestor").select("node").distinct()
        if on_cycle.take(1):
            # these become tops for now: what is below them still finds them, and is refused in the end
            looped = cut(looped.union(on_cycle))
            jump, reach = (cut(t.join(looped, "node", "left_anti")) for t in (jump, reach))
        if not jump.take(1):
            break
        on = jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        further = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        reach = cut(reach.union(jump.join(further, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("more") + step).alias("distance"))).distinct())
        jump = cut(jump.join(on, "ancestor").select("node", F.col("next").alias("ancestor")))
        step *= 2
    else:
        raise RuntimeError(f"the tree is deeper than 2 ** {max_rounds}")
    lost = cut(reach.join(looped.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").union(looped).distinct())
    refused = orphans.join(lost, "node", "left_anti").union(lost.select("node", F.lit("cycle").alias("reason")))
    return reach.join(lost, "node", "left_anti").select("node", "ancestor", "distance"), refused


def write_categories(parents: DataFrame, children: DataFrame, path: str, crawled_at: str, most: int = 20_000) -> None:
    """JSON documents of both lists, in the order of their ids. Over `most` entries there are several documents, each
    with its stretch of both lists; together they hold everything."""
    by_number = lambda c: F.lpad(c, 20, "0")
    pieces = []
    for rows, field, order in ((parents, "parent_categories", ("parent_id", "url")), (children, "subcategories", ("parent_id", "sub_id"))):
        keyed = rows.select(*[by_number(F.col(c)).alias(f"o{i}") if c.endswith("_id") else F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("entry"))
        placed = numbered_in_order(keyed, "o0", "o1").select(((F.col("n") - 1) / most).cast("long").alias("document"), "n", "entry")
        listed = placed.groupBy("document").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]).alias(field))
        pieces.append(listed)
    both = pieces[0].join(pieces[1], "document", "full_outer")
    lists = [F.coalesce(F.col(name), F.from_json(F.lit("[]"), f"array<struct<{kind.replace(' string', ':string')}>>")).alias(name) for name, kind in (("parent_categories", PARENT), ("subcategories", CHILD))]
    both.select(*lists, F.lit(crawled_at).alias("crawled_at")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two lists of category documents, pretty-printed or one a line. A broken document is an error."""
    one_per_line = spark.read.schema(FILE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return one_per_line.select(F.inline("parent_categories")), one_per_line.select(F.inline("subcategories"))
