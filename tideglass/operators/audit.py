"""Checks as tables of findings: sensitive content, links, unknown fields, broken rules. Found values are never shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of secrets, of credentials and of what stands in for one, of addresses and numbers.
TOKEN = r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----|\b(?:sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{16,}|AKIA[A-Z0-9]{16})\b"
ASSIGNMENT = r"(?i)(?:[\"']?\b(?:[a-z][a-z0-9]*[_-])*(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret|cookie)[\"']?)\s*[:=]\s*[\"']?([^\s\"',;]+)"
STAND_IN = r"^(?:(?i:<[^>]+>|\$\{[^}]+\}|\*+|REDACTED|EXAMPLE|PLACEHOLDER|CHANGEME|YOUR_[A-Z_]+|None|False|True)$|os\.environ|process\.env|re\.compile|r\"|r')"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~-]{16,}"
EMAIL = r"(?<![\w.-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w.-])"
RESERVED_DOMAIN = r"^(?:example\.(?:com|org|net)|.*\.(?:invalid|test))$"
IDENTITY_CARD = r"(?<!\d)([1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?!\d)"
SAMPLE_CARD, SAMPLE_PHONE = "110101199001010000", "13800138000"
PHONES = [r"(?<!\d)((?:\+?86[- ]?)?1[3-9]\d{9})(?!\d)", r"(?<!\d)(\+65[- ]?[689]\d{3}[- ]?\d{4})(?!\d)", r"(?i)(?:phone|mobile|telephone|手机号|电话)[\"']?\s*[:=：]\s*[\"']?(\+?[\d ()-]{7,20})"]


def is_example(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("tests", "test", "fixtures", "examples")])) | name.contains(".example.") | name.endswith(".example") | name.startswith("example.")


def sensitive(line: Column, example: Column) -> Column:
    """The categories of sensitive content of a line; in examples, reserved domains and sample numbers are allowed."""
    none = F.array().cast("array<string>")
    found = lambda pattern, guard: F.when(guard, F.regexp_extract_all(line, F.lit(pattern), F.lit(1))).otherwise(none)
    digits_at_all = line.rlike(r"\d{3}")
    assigned = F.exists(found(ASSIGNMENT, line.rlike("[:=]") & line.rlike("(?i)key|token|passw|secret|cookie")), lambda v: (F.length(v) >= 6) & ~v.rlike(STAND_IN))
    mail = F.exists(found(EMAIL, line.contains("@")), lambda d: ~(example & F.lower(d).rlike(RESERVED_DOMAIN)))
    card = F.exists(found(IDENTITY_CARD, line.rlike(r"\d{17}")), lambda n: ~(example & (n == SAMPLE_CARD)))
    digits = F.transform(F.concat(*[found(p, digits_at_all) for p in PHONES]), lambda n: F.regexp_replace(n, r"\D", ""))
    phone = F.exists(digits, lambda n: (F.length(n) >= 7) & ~(example & ((n == SAMPLE_PHONE) | n.rlike("^0+$"))))
    return F.array_compact(
        F.array(
            F.when(line.rlike(TOKEN), "secret-token"), F.when(assigned, "credential-assignment"), F.when(line.rlike(BEARER), "bearer-credential"),
            F.when(mail, "email-address"), F.when(card, "identity-card-number"), F.when(phone, "phone-number"),
        )
    )


def scan(lines: DataFrame) -> DataFrame:
    """(path, line, text) -> (severity, path, line, category), each finding once."""
    return lines.select("path", "line", F.explode(sensitive(F.col("text"), is_example(F.col("path")))).alias("category")).select(F.lit("error").alias("severity"), "path", "line", "category").distinct()


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def unknown_fields(rows: DataFrame, names: Column, allowed: list[str], required: list[str]) -> DataFrame:
    """Rows with field names that are not allowed or that are missing."""
    unknown = F.array_except(names, F.array(*[F.lit(a) for a in allowed]))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), names) if required else F.array().cast("array<string>")
    return rows.withColumn("unknown", unknown).withColumn("missing", missing).where((F.size("unknown") > 0) | (F.size("missing") > 0))


def strict_json(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``valid``: JSON without repeated keys or odd constants."""
    return rows.withColumn("valid", F.try_parse_json(text).isNotNull() & ~F.col(text).rlike(r"[:\[,]\s*-?(?:NaN|Infinity)\b"))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of links to no file: not the path itself, not with ``.md``, not a folder, not a unique file name."""
    whole = files.select(F.col("path").alias("t"))
    with_md = files.where(F.col("path").endswith(".md")).select(F.expr("substring(path, 1, length(path) - 3)").alias("t"))
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))).alias("t")).where("t <> ''")
    names = files.select(F.element_at(parts, -1).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("t")
    known = whole.unionByName(with_md).unionByName(folders).unionByName(names).distinct()
    return links.join(known, F.regexp_replace(F.col("target"), "/+$", "") == F.col("t"), "left_anti")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases of more than one region."""
    return aliases.groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("region").alias("n_regions")).where("n_regions > 1")


def evidence_rules(events: DataFrame) -> DataFrame:
    """(event_id, rule) of the rules that events (event_id, schema_version, confirmed_on, observed_at, evidence, aliases, url) break."""
    rules = {
        "unsupported schema version": ~F.col("schema_version").eqNullSafe(F.lit(1)),
        "date required": F.col("confirmed_on").isNull() | ~F.col("confirmed_on").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("confirmed_on").try_cast("date").isNull(),
        "time with a zone required": F.col("observed_at").isNotNull() & ~F.col("observed_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}.*(?:Z|[+-]\d{2}:\d{2})$"),
        "1 to 20 pieces of evidence": ~F.coalesce(F.size("evidence").between(1, 20), F.lit(False)),
        "at most 20 aliases": F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 20,
        "safe address required": F.col("url").isNotNull() & ~F.coalesce(F.col("url").rlike(r"^https?://[^/?#@\s<>|]+(?:[/?#][^\s<>|]*)?$"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return events.select("event_id", F.explode(broken).alias("rule"))
