"""Content-derived identifiers as column expressions.

Every id is a prefix and a SHA-256 digest of a colon-joined key, so the same
input gives the same id on every machine and in every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes, lengths and rule names of identifiers.
SHORT = 24
EPOCH_SPAN = 1_000_000_000
RULE_COOCCURRENCE = "link.source_cooccurrence.v1"


def digest(value: Column) -> Column:
    """Hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def canonical_key(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("ent_"), digest(key))


def run_id(inputs_hash: Column, config_hash: Column) -> Column:
    return F.concat(F.lit("run_"), digest(F.concat(inputs_hash, config_hash)))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.left(digest(path), F.lit(SHORT)))


def segment_id(document: Column, kind: Column, order: Column, text: Column) -> Column:
    return F.concat(F.lit("seg_"), F.left(digest(joined(document, kind, order, text)), F.lit(SHORT)))


def chunk_id(document: Column, order: Column, text: Column) -> Column:
    return F.concat(F.lit("chk_"), F.left(digest(joined(document, order, text)), F.lit(SHORT)))


def git_id(kind: str, repo: str, *parts: Column) -> Column:
    """Ids of commits, authors, tags, refs and (without parts) the repository."""
    return F.concat(F.lit(f"{kind}_"), digest(joined(repo, *parts)))


def link_id(rule: Column | str, source: Column, target: Column) -> Column:
    return F.concat(F.lit("lnk_"), digest(joined(rule, source, target)))


def claim_id(text: Column) -> Column:
    return F.concat(F.lit("clm_"), digest(text))


def deterministic_timestamp(seed: Column) -> Column:
    """An ISO instant from the first 32 bits of the seed's digest, modulo 10^9 seconds."""
    seconds = F.conv(F.left(digest(seed), F.lit(8)), 16, 10).cast("long") % EPOCH_SPAN
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def set_digest(hashes: Column) -> Column:
    """Aggregate: digest of all hashes of a group, independent of their order."""
    return digest(F.array_join(F.array_sort(F.collect_list(hashes)), ":"))
