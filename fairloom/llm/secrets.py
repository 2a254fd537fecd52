"""Secret scans with a ledger of what has been scanned already.

Every version of a text is content-addressed: its blob is the SHA-256 of its UTF-8 bytes. The ledger is a pair of
tables in the shared folder: scans, one row for each blob, rule and rule version that was scanned, with the spans
found; and paths, every blob that a path ever had. A run adds its paths, scans only the pairs of blob and rule version
that the scans lack, each blob once however many documents hold it, appends what it found, and joins the ledger's
findings back to all paths. Given the folder of an earlier run, a run over the same texts scans nothing; without one
it starts a ledger of its own. All of it is DataFrame operations: a blob's text comes from the row with the smallest
key, found on hashes alone, so texts are shuffled once and hot texts never meet in one task. Findings are cut off from
the plan that made them, so that a blob with very many paths is split by adaptive execution in the join.

Spans are half-open ranges of code points. Within a text all work is linear in its length, but for a logarithm of the
number of matches: running sums double their reach step by step.

Defined results: a null text is the empty blob; null keys and repeated rows are paths like any other; an empty table
gives an empty result. Columns that clash with names used here don't matter; results keep the input's columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.llm.common import unused
from fairloom.operators.storage import cut, shared_folder


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost first and not overlapping, whose group value_group has min_value characters."""

    kind: str
    pattern: str
    value_group: int = 0
    min_value: int = 0
    version: int = 1


# Fixed rules. A run of hex digits (or of what may follow AKIA) is matched greedily from its first character on, so
# asking for the length in the pattern finds the same runs as dropping the short ones afterwards.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Added to these: whole private keys (or what is left of one), and web tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
ALL_RULES = (*RULES, *MORE_RULES)
#: start and end in code points; first and stop are the same places in bytes.
_SPANS = "array<struct<start:int,end:int,first:int,stop:int>>"
LEDGER = f"blob string, rule string, rule_version int, spans {_SPANS}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """All prefixes of an array joined (added, say): in each step every place takes in what twice as many hold."""

    def step(state: Column, reach: Column) -> Column:
        return F.transform(state, lambda x, i: F.when(i < reach, x).otherwise(join(x, F.get(state, i - reach))))

    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    reaches = F.transform(F.sequence(F.lit(0), steps), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.when(F.size(values) > 1, F.aggregate(reaches, values, step)).otherwise(values)


def rule_spans(text: Column, rule: Rule) -> Column:
    """All spans of a rule in a text. Places follow from the lengths of matches and of the gaps between them."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value_group)) if rule.min_value else found
    size = lambda s: F.struct(F.char_length(s).alias("c"), F.octet_length(s).alias("b"))
    each = F.arrays_zip(F.transform(found, size).alias("m"), F.transform(values, F.char_length).alias("v"), F.transform(F.split(text, rule.pattern, -1), size).alias("g"))
    # split gives a gap more than there are matches; its row has no match
    each = F.filter(each, lambda x: x["m"].isNotNull())

    def placed(rows: Column) -> Column:
        ends = running(
            F.transform(rows, lambda x: F.struct((x["g"]["c"] + x["m"]["c"]).alias("c"), (x["g"]["b"] + x["m"]["b"]).alias("b"))),
            lambda a, b: F.struct((a["c"] + b["c"]).alias("c"), (a["b"] + b["b"]).alias("b")),
        )
        both = F.filter(F.arrays_zip(rows.alias("x"), ends.alias("e")), lambda r: r["x"]["v"] >= rule.min_value)
        return F.transform(both, lambda r: F.struct(
            (r["e"]["c"] - r["x"]["m"]["c"]).alias("start"), r["e"]["c"].alias("end"), (r["e"]["b"] - r["x"]["m"]["b"]).alias("first"), r["e"]["b"].alias("stop"),
        ))

    none = F.array().cast(_SPANS)
    return F.when(text.rlike(rule.pattern), let(each, placed).cast(_SPANS)).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version in docs that ledger doesn't have yet."""
    held = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("blob", blob_of(F.col("body")))
    first = held.groupBy("blob").agg(F.min("path").alias("first_path"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is not None:
        pairs = first.withColumn("pair", F.explode(wanted)).select("blob", "first_path", "pair.rule", "pair.rule_version")
        unseen = pairs.join(ledger.select("blob", "rule", "rule_version"), ["blob", "rule", "rule_version"], "left_anti")
        first = unseen.groupBy("blob").agg(F.min("first_path").alias("first_path"), F.collect_set("rule").alias("todo"))
    else:
        first = first.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    first = first.withColumnRenamed("blob", "first_blob").hint("shuffle_hash")
    texts = held.join(first, (held["blob"] == first["first_blob"]) & held["path"].eqNullSafe(first["first_path"]))
    body = F.col("body")
    scanned = texts.select("blob", "todo", *[
        F.when(F.array_contains("todo", r.kind), rule_spans(body, r)).alias(f"spans_{i}") for i, r in enumerate(rules)
    ])
    rows = F.array(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.col(f"spans_{i}").alias("spans"))
        for i, r in enumerate(rules)
    ])
    out = scanned.select("blob", F.explode(rows).alias("x")).select("blob", "x.rule", "x.rule_version", "x.spans").where("spans is not null")
    # rows that repeat key and text gave the same blob more than once
    return out.groupBy("blob", "rule", "rule_version").agg(F.first("spans").alias("spans"))


class Ledger:
    """The ledger's two tables in a folder, which need not be there yet."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(str(path)) if there else self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._table("scans", LEDGER)

    def paths(self) -> DataFrame:
        """path (as a string) and blob of every version that was ever seen, once."""
        return self._table("paths", "path string, blob string").distinct()

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, key: str = "doc_id", text: str = "text") -> None:
        """Scan what is new in docs, and add it."""
        docs.select(F.col(key).cast("string").alias("path"), blob_of(F.col(text)).alias("blob")).write.mode("append").parquet(f"{self.folder}/paths")
        known = self.scans()
        scan_blobs(docs, None if known.isEmpty() else known, rules, key, text).write.mode("append").parquet(f"{self.folder}/scans")

    def findings(self, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
        """blob, spans (array of start, rank, kind, end, first, stop, in order) of every blob in which any rule found something."""
        rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule")).cast("int")
        with_kind = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end"), s["first"].alias("first"), s["stop"].alias("stop")))
        current = F.concat_ws("@", "rule", "rule_version").isin([f"{r.kind}@{r.version}" for r in rules])
        hit = self.scans().where(current & (F.size("spans") > 0)).select("blob", "rule", with_kind.alias("spans"))
        hit = hit.groupBy("blob", "rule").agg(F.first("spans").alias("spans"))  # two runs at a time may both have scanned a blob
        return cut(hit.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))

    def findings_by_path(self, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
        """path, blob, spans of every version of every path in which any rule found something."""
        return self.paths().join(self.findings(rules), "blob").select("path", "blob", "spans")


def secrets_by_path(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = ALL_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every row of docs, its blob and its spans (empty where nothing was found)."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, rules, key, text)
    hit = ledger.findings(rules).select(F.col("blob").alias("hit_blob"), F.col("spans").alias("hit_spans"))
    paths = docs.select(F.col(key), blob_of(F.col(text)).alias(unused("blob", key)))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,first:int,stop:int>>")
    joined = paths.join(hit, paths[unused("blob", key)] == hit["hit_blob"], "left")
    return joined.select(paths[key], paths[unused("blob", key)], F.coalesce(hit["hit_spans"], none).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, key: str = "doc_id", ledger: Ledger | None = None) -> DataFrame:
    base = [r.kind for r in RULES]
    found = secrets_by_path(docs, ledger, key=key)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(key, *map(count, base), F.sha2(_listed(only_base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with mark in place of its spans; spans that overlap share one."""

    def joined(parts: Column) -> Column:
        body, spans, far = parts["body"], parts["spans"], parts["far"]
        before = lambda i: F.coalesce(F.get(far, i - 1), F.lit(0))
        each = F.transform(spans, lambda s, i: F.when(s["first"] >= before(i), F.concat(F.substring(body, before(i) + 1, s["first"] - before(i)), F.lit(mark).cast("binary"))))
        kept = F.transform(F.filter(each, lambda x: x.isNotNull()), lambda x: x.cast("string"))
        last = F.element_at(far, -1)
        return F.concat(F.array_join(kept, ""), F.substring(body, last + 1, F.octet_length(body) - last).cast("string"))

    far = running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    return let(F.struct(text.cast("binary").alias("body"), spans.alias("spans"), far.alias("far")), joined)


def redact(docs: DataFrame, mark: str = "[SECRET]", key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = ALL_RULES, ledger: Ledger | None = None) -> DataFrame:
    """docs with every span replaced by mark (spans that overlap, by one). n_chars, where there is one, follows."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, rules, key, text)
    blob, hit_blob, spans = (unused(c, *docs.columns) for c in ("blob", "hit_blob", "hit_spans"))
    hit = ledger.findings(rules).select(F.col("blob").alias(hit_blob), F.col("spans").alias(spans))
    marked = docs.withColumn(blob, blob_of(F.col(text)))
    joined = marked.join(hit.hint("shuffle_hash"), marked[blob] == hit[hit_blob], "left")
    changed = {text: F.when(F.col(spans).isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col(spans), mark))}
    out = joined.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
