"""Quality rules from cross-document line frequency, in DataFrame functions only.

A line is normalised (trimmed, lower case, white space runs to one space, digit
runs to 0) and hashed. For each host the distinct documents that hold a line are
counted; documents with the same text count once, so copies alone make no line
frequent. A line is boilerplate in more than ``share`` of the host's documents,
but never in ``min_docs`` or fewer and always in more than ``max_docs``, so the
limit does not grow with a large host. Boilerplate lines are removed, and a
document that keeps less than ``keep_share`` of its words is rejected.

Texts are read once: figures and line hashes are written as a table, and counts
and verdicts come from it. Lines meet their host's boilerplate in a shuffled join
on (host, line). Lines that make up more than 1 / ``HEAVY`` of all lines, so at
most ``HEAVY``, would be hot keys there; they are broadcast instead. Counts meet
the host's limit with a salt, so a hot host is spread.

Defined results: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows each get a row and count once as documents;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, native_words, text_or_empty, written

MIN_DOCS, MAX_DOCS = 5, 20
SHARE = 0.05
HEAVY, SALTS = 4096, 32
KEEP_SHARE = 0.3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]+", "0")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the array holds twice or more."""

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(p: Column) -> Column:
            twice = F.filter(F.transform(p, lambda x, j: F.when((x["k"] == F.get(p, j - 1)["k"]) | (x["k"] == F.get(p, j + 1)["k"]), x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(pairs, places))

    def windows(hashes: Column) -> Column:
        keys = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, hashes[i + 1], hashes[i + 2]))
        return let(keys, covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def base_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host_, two hashes of the text, the base figures, and arrays of line hashes and line sizes."""
    picked = docs.select("doc_id", F.col(host).alias("host_"), text_or_empty().alias("text_"))
    counted = picked.select(
        "doc_id",
        "host_",
        F.xxhash64("text_").alias("a"),
        F.xxhash64(F.lit(1), "text_").alias("b"),
        let(
            native_words(F.col("text_")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        (F.length(F.translate("text_", WHITE, ""))).cast("long").alias("word_chars"),
        (F.length("text_") - F.length(F.translate("text_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            lines_with_words(F.col("text_")),
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.transform(x, lambda line: F.xxhash64(normalised(line))).alias("hashes"),
                F.transform(x, lambda line: F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))).alias("sizes"),
            ),
        ).alias("l"),
    )
    return counted.select("doc_id", "host_", "a", "b", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.hashes", "l.sizes")


def line_counts(stored: DataFrame, min_docs: int, max_docs: int, share: float) -> DataFrame:
    """(host_, line, uses, frequent) of the lines that are boilerplate or heavy; ``uses`` counts all rows."""
    total = stored.agg(F.sum(F.size("hashes"))).first()[0] or 0
    texts = stored.select("host_", "a", "b", F.explode("hashes").alias("line")).groupBy("host_", "line", "a", "b").agg(F.count(F.lit(1)).alias("uses"))
    counts = texts.groupBy("host_", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    heavy = F.col("uses") * HEAVY > total
    counts = counts.where((F.col("n") > min_docs) | heavy).withColumn("salt", F.pmod("line", F.lit(SALTS)))
    hosts = stored.select("host_", "a", "b").distinct().groupBy("host_").agg(F.count(F.lit(1)).alias("docs"))
    limits = hosts.select("host_", F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), F.col("docs") * share)).alias("limit_"))
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = counts.alias("c").join(limits.alias("h"), F.expr("c.host_ <=> h.host_ and c.salt = h.salt"))
    marked = joined.select("c.host_", "line", heavy.alias("heavy"), ((F.col("n") > min_docs) & (F.col("n") > F.col("limit_"))).alias("frequent"))
    return written(marked.where("heavy or frequent"))


def removed_words(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """(rid, n_removed_words) of the documents with boilerplate lines."""
    lines = stored.select("rid", "host_", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).select("rid", "host_", F.col("x.hashes").alias("line"), F.col("x.sizes").alias("size"))
    heavy = counts.where("heavy").select(F.col("host_").alias("host_h"), F.col("line").alias("line_h"), F.col("frequent").alias("known"))
    light = counts.where("frequent and not heavy").select(F.col("host_").alias("host_f"), F.col("line").alias("line_f"))
    lines = lines.join(F.broadcast(heavy), F.expr("host_ <=> host_h and line = line_h"), "left")  # at most HEAVY rows
    rest = lines.where("known is null").join(light, F.expr("host_ <=> host_f and line = line_f"), "left_semi")
    both = lines.where("known").select("rid", "size").unionByName(rest.select("rid", "size"))
    return both.groupBy("rid").agg(F.sum("size").cast("long").alias("n_removed_words"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_docs: int = MAX_DOCS, share: float = SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The base figures, base_failed, kept, and the words in removed lines."""
    stored = written(base_features(docs, host).withColumn("rid", F.monotonically_increasing_id()))
    removed = removed_words(stored, line_counts(stored, min_docs, max_docs, share))
    out = stored.drop("hashes", "sizes").join(removed, "rid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= keep_share * F.col("n_words"))
    return out.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed_words")


ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select rid, generate_subscripts(ws, 1) as i, unnest(ws) as w
  from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)
),
g as (
  select rid, i, w, lead(w, 1) over p as w1, lead(w, 2) over p as w2 from w window p as (partition by rid order by i)
),
t as (select rid, i, count(*) over (partition by rid, w, w1, w2) as n from g where w2 is not null),
r as (
  select rid, count(distinct j) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as j from t where n > 1) group by rid
),
nw as (select rid, count(*) as n_words, sum(length(w)) as word_chars from w group by rid),
raw as (
  select rid, doc_id, source, text, unnest(string_split(text, chr(10))) as line from d
),
l as (
  select rid, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') as norm
  from raw where regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from l group by rid),
h as (select source, least({float(MAX_DOCS)}, greatest({float(MIN_DOCS)}, count(distinct text) * {SHARE})) as lim from d group by source),
f as (
  select l.source, norm from l join h on l.source is not distinct from h.source
  group by l.source, norm, lim having count(distinct text) > lim and count(distinct text) > {MIN_DOCS}
),
rem as (
  select rid, sum(n) as n_removed from l
  where exists (select 1 from f where f.source is not distinct from l.source and f.norm = l.norm) group by rid
),
s as (
  select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_removed, 0)::bigint as n_removed_words
  from d left join nw using (rid) left join dup using (rid) left join r using (rid) left join rem using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words)
    and n_words - n_removed_words >= {KEEP_SHARE} * n_words as kept,
  n_removed_words
from s
"""
