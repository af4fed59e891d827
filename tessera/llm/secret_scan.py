"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every file is addressed by the SHA-256 of its content. The
ledger holds, for each blob and rule version that were scanned, the findings;
a scan works on blobs and rule versions that the ledger hasn't seen, once for
each blob, and joins all findings back to every path. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .spans import Rule, spans

# The rules. Base kinds first; the others add spans.
RULES = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""", keep=lambda v: F.length(F.regexp_extract(v, r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 1)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]++", keep=lambda v: F.length(v) >= 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("service_token", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|AIza[A-Za-z0-9_-]{35,}+)"),
)
BASE = ("assign", "access", "hex")

LEDGER_SCHEMA = "blob string, rule string, version int, findings array<struct<start:bigint,end:bigint>>"


def blob_address(text: Column) -> Column:
    """The SHA-256 of the UTF-8 bytes; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, version, findings) for all blobs and rule versions that ``ledger`` lacks.

    Equal contents are scanned once. Blobs without findings get rows with an
    empty array, so that they aren't scanned again.
    """
    blobs = versions.select(blob_address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("seen"))
        known = F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules])
        done = seen.filter(F.size(F.array_except(known, F.col("seen"))) == 0).select("blob")
        blobs = blobs.join(done, "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    found = []
    for r in rules:
        due = ~F.coalesce(F.array_contains("seen", f"{r.name}:{r.version}"), F.lit(False))
        marks = F.transform(spans(F.col("text"), r.pattern, r.keep), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        found.append(F.when(due, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), marks.alias("findings"))))
    rows = blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("blob", "f.rule", "f.version", "f.findings")


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every row of ``versions`` with ``blob`` and ``findings``, the ledger's new rows).

    ``findings`` is an array of (rule, start, end), positions in code points,
    ordered by start, the rules' order and end; it is empty where nothing was
    found. Null and empty texts are one blob. Repeated rows, and other paths of
    a blob, all get its findings; only the current version of a rule counts.
    Input columns of the added names are replaced; an empty table gives an
    empty result and no ledger rows. The new rows are written to the shared
    folder before they are joined, so a lost executor scans nothing twice.
    """
    new = cut(scan_new(versions, ledger, rules=rules, text=text), "ledger")
    current = F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules])
    entries = (new if ledger is None else new.unionByName(ledger.select("blob", "rule", "version", "findings"))).filter(F.size("findings") > 0)
    entries = entries.filter(F.array_contains(current, F.concat_ws(":", "rule", F.col("version").cast("string")))).dropDuplicates(["blob", "rule"])
    place = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    each = F.transform("findings", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("rule").alias("rule")))
    by_blob = entries.withColumn("place", place).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("found"))
    rows = fresh(versions, "blob", "findings").withColumn("blob", blob_address(F.col(text)))
    joined = rows.join(cut(by_blob, "findings"), "blob", "left")
    findings = F.coalesce(F.transform("found", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], findings.alias("findings")), new


def secrets_digest(documents: DataFrame) -> DataFrame:
    found, _ = scan(documents.select("doc_id", "text"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["rule"].isin(*BASE))
    n = lambda kind: F.size(F.filter("findings", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
