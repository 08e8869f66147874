"""Secret detectors, keyed redaction of text columns, and the audit of stored text."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    pattern: str
    group: int = 0


# What counts as a secret. The patterns read the same in Python and Java.
DETECTORS = (
    Detector("pem_private_key", "private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    Detector("jwt", "jwt", r"\b[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    Detector("bearer_token", "bearer", r"(?i)authorization:\s*bearer\s+([A-Za-z0-9._~-]+)", 1),
    Detector(
        "credential_kv",
        "credential",
        r"(?i)\b(password|secret|token|api_key|apikey|client_secret|private_key|aws_access_key_id|aws_secret_access_key|auth_token|access_token|refresh_token|session_token|passwd|pwd|bearer|auth)\s*[:=]\s*([^\s\"']+)",
        2,
    ),
    Detector("url_credentials", "url_credential", r"(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:([^@\s]+)@", 1),
    Detector("vendor_token", "vendor_token", r"(?:ghp_[A-Za-z0-9]{12,}|github_pat_[A-Za-z0-9_]{20,}|gho_[A-Za-z0-9]{12,}|ghu_[A-Za-z0-9]{12,}|ghs_[A-Za-z0-9]{12,}|ghr_[A-Za-z0-9]{12,}|xoxe\.xoxp-[A-Za-z0-9-]{10,}|xox[baprs]-[A-Za-z0-9-]{10,})"),
    Detector("cloud_keys", "cloud_keys", r"(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|sk-ant-api\d{2}-[A-Za-z0-9_\-]{40,}|sk-proj-[A-Za-z0-9_\-]{40,}|sk-[A-Za-z0-9]{48}|sk_live_[A-Za-z0-9]{24,})"),
)
DEFAULT = tuple(d.name for d in DETECTORS if d.name != "cloud_keys")
MARKER = r"<<redacted:[a-z_]+:[0-9a-f]{12}>>"
#: What an audit reads instead of a marker: no pattern has a secret that begins with it.
GAP = ' "'


#: Detectors that a configuration adds, by name.
CUSTOM: dict[str, Detector] = {}


def register(detector: Detector) -> None:
    """Adds a detector that ``chosen`` finds by its name; its pattern must read the same in Python and Java."""
    re.compile(detector.pattern)
    if not re.fullmatch("[a-z_]+", detector.category):
        raise ValueError(f"category {detector.category!r} cannot stand in a marker")
    CUSTOM[detector.name] = detector


def chosen(names: Iterable[str] = DEFAULT) -> list[Detector]:
    """Detectors by name, in the order asked for; unknown names are left out."""
    known = {d.name: d for d in DETECTORS} | CUSTOM
    return [known[n] for n in names if n in known]


def marker(category: str, secret: str, key: bytes) -> str:
    return f"<<redacted:{category}:{hmac.digest(key, secret.encode(), "sha256").hex()[:12]}>>"


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


_MARKED = re.compile(f"({MARKER})")


def redact_value(text: str, key: bytes, detectors: list[Detector]) -> tuple[str, dict[str, int]]:
    """The text with every secret replaced, and counts by category. Markers are never redacted again."""
    counts: dict[str, int] = {}
    for d in detectors:
        found = _compiled(d.pattern)
        if "<<redacted:" not in text and not found.search(text):
            continue
        out = []
        # Every second part is a marker.
        for k, part in enumerate(_MARKED.split(text)):
            if k % 2:
                out.append(part)
                continue
            at = 0
            for m in found.finditer(part):
                out += [part[at : m.start(d.group)], marker(d.category, m.group(d.group), key), part[m.end(d.group) : m.end()]]
                at = m.end()
                counts[d.category] = counts.get(d.category, 0) + 1
            out.append(part[at:])
        text = "".join(out)
    return text, counts


def redactor(key: bytes, names: Iterable[str] = DEFAULT):
    """A vectorised function of a text column; the key stays in the closure and never becomes a column."""
    detectors = chosen(names)

    @F.pandas_udf("string")
    def redact(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redact_value(t, key, detectors)[0], na_action="ignore")

    return redact


def _holds_text(kind: T.DataType) -> bool:
    """Whether values of a type can hold strings."""
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    return _holds_text(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.StringType)


def redact_any(value: object, key: bytes, detectors: list[Detector], kind: T.DataType) -> object:
    """Every string inside a nested value redacted; map keys stay."""
    if value is None or not _holds_text(kind):
        return value
    if isinstance(kind, T.StringType):
        return redact_value(value, key, detectors)[0]
    if isinstance(kind, T.ArrayType):
        return [redact_any(v, key, detectors, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(k, redact_any(v, key, detectors, kind.valueType)) for k, v in value]
    return {f.name: redact_any(value[f.name], key, detectors, f.dataType) for f in kind.fields}


def _nested_redacted(df: DataFrame, key: bytes, names: Iterable[str], columns: list[str]) -> DataFrame:
    detectors, schema = chosen(names), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for c in columns:
                at = batch.schema.get_field_index(c)
                values = [redact_any(v, key, detectors, schema[c].dataType) for v in arrays[at].to_pylist()]
                arrays[at] = pa.array(values, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(run, schema)


def redacted(df: DataFrame, key: bytes, names: Iterable[str] = DEFAULT) -> DataFrame:
    """Every string redacted, in columns, arrays, structs and map values; other values as they are.

    Strings that no detector matches never leave the JVM: the redacting function gets null for them.
    """
    found = chosen(names)
    redact_all = redactor(key, names)

    def redact(c: Column) -> Column:
        if not found:
            return c
        suspect = c.rlike(found[0].pattern)
        for d in found[1:]:
            suspect = suspect | c.rlike(d.pattern)
        return F.coalesce(redact_all(F.when(suspect, c)), c)

    nested = [f.name for f in df.schema.fields if _holds_text(f.dataType) and not isinstance(f.dataType, T.StringType) and f.dataType != T.ArrayType(T.StringType())]
    if nested and found:
        df = _nested_redacted(df, key, names, nested)
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = redact(c).alias(f.name)
        elif f.dataType == T.ArrayType(T.StringType()):
            # Joined by a separator that no pattern crosses, so arrays need no Python loop.
            c = F.when(F.size(c) > 0, F.split(redact(F.array_join(c, "\u001e", "\u001f")), "\u001e")).otherwise(c)
            c = F.transform(c, lambda x: F.nullif(x, F.lit("\u001f"))).alias(f.name)
        columns.append(c)
    return df.select(*columns)


def keyed_digest(column: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a string column in hex, by the inner and outer pad; no Python."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), column.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def misses(df: DataFrame, path: str, names: Iterable[str] = DEFAULT) -> DataFrame:
    """(path, category, field) of every string field that still holds a secret; never the value."""
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != path]
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.regexp_replace(F.col(f"`{n}`"), MARKER, GAP).alias("value")) for n in fields))
    rows = df.select(F.col(path).cast("string").alias("path"), F.explode(pairs).alias("p")).select("path", "p.field", "p.value")
    found = F.array_compact(F.array(*(F.when(F.col("value").rlike(d.pattern), F.lit(d.category)) for d in chosen(names))))
    return rows.select("path", F.explode(found).alias("category"), "field").distinct()


def redaction_summary(df: DataFrame, column: str, names: Iterable[str] = DEFAULT) -> DataFrame:
    """(category, n): how many secrets each detector finds in a column."""
    counts = F.array(*(F.struct(F.lit(d.category).alias("category"), F.regexp_count(F.col(column), F.lit(d.pattern)).alias("n")) for d in chosen(names)))
    return df.select(F.explode(counts).alias("c")).groupBy("c.category").agg(F.coalesce(F.sum("c.n"), F.lit(0)).cast("long").alias("n"))


def validated(found: DataFrame, scanned: DataFrame, profile: str = "profile") -> DataFrame:
    """(profile, scanned, misses, status) and a row ``_total``; ``found`` and ``scanned`` both have the profile."""
    a = scanned.groupBy(profile).agg(F.count(F.lit(1)).alias("scanned"))
    b = found.groupBy(profile).agg(F.count(F.lit(1)).alias("misses"))
    rows = a.join(b, profile, "left").withColumn("misses", F.coalesce("misses", F.lit(0)))
    out = rows.rollup(profile).agg(F.sum("scanned").alias("scanned"), F.sum("misses").alias("misses"))
    return out.select(F.coalesce(profile, F.lit("_total")).alias("profile"), "scanned", "misses", F.when(F.col("misses") > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("status"))


class PostconditionFailed(RuntimeError):
    """Secrets are left in the store; the command line exits with 3."""


def postcondition(found: DataFrame, tolerate: bool = False) -> dict[str, object]:
    """The status of an audit: pass, tolerated, or an error."""
    n = found.count()
    if n and not tolerate:
        raise PostconditionFailed(f"{n} unredacted fields")
    return {"status": "tolerated" if n else "pass", "misses": n}
