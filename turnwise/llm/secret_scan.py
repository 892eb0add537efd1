"""Secret scans over an incremental blob ledger.

A *path* is anything that has a text (a document, or one historical version of a file). Its text is
content-addressed: the blob id is the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table with
one row per scanned (blob, rule, rule version), holding the spans found (often none). A scan

1. digests every path (written once, ids and digests only),
2. asks the ledger with the distinct blob ids: what is left are the (blob, rule) pairs whose rule version
   it has not seen, written,
3. fetches the texts of those blobs alone. If the ids left fit a broadcast they are met where the texts are
   read, so no text of a blob that the ledger knows is shuffled; beyond it they meet in a shuffle. One text per
   blob is kept (a map-side combined aggregate, so a blob with a third of the paths leaves each task once),
4. scans them and appends the rows to the ledger in one write,
5. joins the spans back to all paths by blob.

Span positions come from Spark's own functions: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, so a running sum of their lengths (a window inside a blob and
rule) gives the start of each match in code points.

Only DataFrame functions are used. The patterns match leftmost and non-overlapping; a match that is
too short is dropped after matching, so it still uses up its text. Since the ledger adds no rule,
all spans are base spans.

Edge cases: null text is the empty blob, which has no spans; repeated rows are paths of the same
blob; an empty table gives an empty result and leaves the ledger as it is; an interrupted append
can leave rows that a later scan repeats, so findings are read once per (blob, rule, version);
columns beyond id and text are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir
from .common import documents, materialize
from .registry import register


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax; a match counts if its ``group`` has ``least`` code points; a text
    without ``hint`` has no match that counts."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# The rules, in the order that breaks ties between equal starts. Runs that are too
# short to count end where a longer run cannot begin, so access and hex look for long runs at once;
# a short assign match can use up the word of a later one, so its length is tested afterwards.
RULES = (
    Rule("assign", 1,
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 8, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)

LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pieces(rule: Rule, text: Column) -> Column:
    """Per match: code points before it (since the match before), of it, and of its counted group."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    return F.when(text.rlike(rule.hint), F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("width"),
        F.transform(counted, F.length).alias("counted")))


def scan_blobs(pending: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``pending`` (blob, text, todo: names of the rules to run)."""
    runs = F.filter(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                                       F.when(F.array_contains("todo", r.name), _pieces(r, F.col("text"))).alias("m"))
                              for r in rules]),
                    lambda x: F.array_contains(F.col("todo"), x["rule"]))
    each = pending.select("blob", F.explode(runs).alias("x"))
    rows = each.select("blob", "x.rule", "x.version", F.posexplode_outer("x.m").alias("at", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.width")).over(upto)
    least = F.create_map(*[F.lit(y) for r in rules for y in (r.name, r.least)])[F.col("rule")]
    spans = rows.withColumn("end", end).withColumn("span", F.when(
        F.col("m.counted") >= least,
        F.struct((F.col("end") - F.col("m.width")).alias("start"), F.col("end").alias("end"))))
    return spans.groupBy("blob", "rule", "version").agg(
        F.array_sort(F.collect_list("span")).alias("spans"))


class BlobLedger:
    """The ledger at ``path`` (a folder on storage that all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)

    def unseen(self, blobs: DataFrame, rules=RULES) -> DataFrame:
        """``blob, todo``: of the distinct ``blobs`` those with rules whose version the ledger has not, and these rules."""
        wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        none = F.array().cast("array<struct<rule:string,version:int>>")
        seen = (self.rows().select("blob", F.struct("rule", "version").alias("r"))
                .groupBy("blob").agg(F.collect_set("r").alias("seen")))
        left = blobs.select("blob").distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(wanted, F.coalesce("seen", none)).alias("left"))
        return left.filter(F.size("left") > 0).select("blob", F.transform("left", lambda x: x["rule"]).alias("todo"))

    def pending(self, texts: DataFrame, blobs: DataFrame, rules=RULES) -> DataFrame:
        """``blob, text, todo``: one text for each unseen blob among ``texts`` (blob, text)."""
        first = lambda d: d.groupBy("blob").agg(F.first("text").alias("text"))
        if self.rows().isEmpty():
            return first(texts).withColumn("todo", F.lit([r.name for r in rules]))
        todo = materialize(self.unseen(blobs, rules))
        ids, small = broadcast_if_small(todo.select("blob"))
        return first(texts.join(ids, "blob", "left_semi") if small else texts).join(todo, "blob")

    def scan(self, texts: DataFrame, rules=RULES, blobs: DataFrame | None = None) -> DataFrame:
        """Scan the blobs among ``texts`` (blob, text) that some rule version has not seen; append; return them.
        ``blobs`` are their ids, if they lie written already."""
        fresh = materialize(scan_blobs(self.pending(texts, texts if blobs is None else blobs, rules), rules))
        fresh.write.mode("append").parquet(self.path)
        return fresh

    def findings(self, rules=RULES) -> DataFrame:
        """``blob, rule, spans`` of the given rule versions, where there are spans."""
        versions = F.create_map(*[F.lit(y) for r in rules for y in (r.name, r.version)])
        return (self.rows().filter((F.col("version") == versions[F.col("rule")]) & (F.size("spans") > 0))
                .dropDuplicates(["blob", "rule", "version"]).select("blob", "rule", "spans"))


def report(findings: DataFrame, rules=RULES) -> DataFrame:
    """One row per blob with findings: a count per rule and the spans as text."""
    order = F.create_map(*[F.lit(y) for i, r in enumerate(rules) for y in (r.name, i)])[F.col("rule")]
    flat = findings.select("blob", "rule", order.alias("k"), F.explode("spans").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct("s.start", "k", "s.end", "rule")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    return flat.groupBy("blob").agg(
        *[F.count(F.when(F.col("rule") == r.name, 1)).alias(f"n_{r.name}") for r in rules], text.alias("spans"))


def scan_paths(df: DataFrame, ledger: BlobLedger, rules=RULES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Scan through ``ledger`` and join back: id, ``blob``, ``n_<rule>`` per rule, ``spans`` for every path."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col), text.alias("text")).withColumn("blob", blob_id(F.col("text")))
    paths = materialize(d.select(id_col, "blob"))
    ledger.scan(d.select("blob", "text"), rules, paths)
    found = report(ledger.findings(rules), rules)
    # only blobs with findings join; AQE splits a blob with very many paths
    return paths.join(found, "blob", "left").select(
        id_col, "blob", *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules],
        F.coalesce("spans", F.lit("")).alias("spans"))


def _sql_kind(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
select doc_id, {order} as k, '{kind}' as kind, w, g, {least} as least,
       sum(gap + w) over (partition by doc_id, line order by i) as e
from (select doc_id, line, i, length(before) as gap, length(whole) as w, length(part) as g
      from (select doc_id, line, unnest(range(len(m))) as i, unnest(p[1:len(m)]) as before, unnest(m) as whole, unnest(g) as part
            from (select doc_id, line, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}', 0) as m,
                         regexp_extract_all(t, '{pattern}', {group}) as g
                  from (select doc_id, row_number() over () as line, coalesce(text, '') as t from documents))))"""


_ASSIGN_SQL = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)")

SQL = f"""
with hits as ({_sql_kind('assign', 0, _ASSIGN_SQL, 2, 8)}
union all {_sql_kind('access', 1, 'AKIA[A-Z0-9]+', 0, 16)}
union all {_sql_kind('hex', 2, '[0-9a-f]+', 0, 32)}),
kept as (select doc_id, k, kind, e - w as s, e from hits where g >= least),
per_doc as (
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
       count(*) filter (kind = 'hex') as n_hex,
       string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) as spans
from (select distinct * from kept) group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc using (doc_id)
"""


@register("op1_secret_scan", sql=SQL)
def op1_secret_scan(spark, sf_dir):
    ledger = BlobLedger(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    return scan_paths(documents(spark, sf_dir), ledger).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
