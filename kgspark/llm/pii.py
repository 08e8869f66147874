"""Personal data: span candidates, boosted trees and calibrated thresholds, in DataFrame functions only.

Patterns give the base spans (email, ip, card, phone); they always stay. Further
generators propose candidates with high recall, which may overlap each other:
digit groups that are no valid card, the parts of a longer run of groups that are
one by themselves, and account numbers that begin with letters (``account``), and
long tokens of mixed characters (``secret``). Gradient-boosted trees over format
and context decide which of them are spans, overlapping ones included. The trees are fitted in numpy on generated
candidates, have integer leaves, and are rendered as column expressions, so the
same sum of integers is compared with the same threshold in every engine.

Defined results: null and empty texts have no spans; offsets count code points,
the end is exclusive; repeated rows each get a row. Patterns start only at the
start of a run of their characters or at the end of the previous match, so a
long run costs linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, text_or_empty, unpacked

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret")
KINDS = BASE + ADDED

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9+/_=-]{16,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
}
#: The same languages for engines without lookbehind and possessive repetition.
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9+/_=-]{16,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
}
CUES = r"(?:token|key|secret|passw|pwd|auth|api|card|account|acct|iban|konto|cuenta|compte|carte)"
ASSIGNED = r"""[=:][ ]*["']?$"""
CONTEXT = 24

# Features of a candidate: all whole numbers.
FEATURES = ("is_secret", "n_chars", "n_digits", "n_letters", "n_gaps", "is_hex", "n_switches", "n_upper", "cued", "assigned", "glued", "n_dashes")


# --------------------------------------------------------------------------- trees


@dataclass(frozen=True)
class Node:
    """value < cut goes left; a leaf has no cut."""

    feature: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = 0


def render(node: Node, value: Callable[[str], object], choose: Callable[[object, int, object, object], object], leaf: Callable[[int], object]):
    """A tree as an expression of some engine: ``choose(feature, cut, left, right)``."""
    if node.left is None:
        return leaf(node.leaf)
    return choose(value(FEATURES[node.feature]), node.cut, render(node.left, value, choose, leaf), render(node.right, value, choose, leaf))


def predict(trees: tuple[Node, ...], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x), np.int64)
    for tree in trees:
        for k in range(len(x)):
            node = tree
            while node.left is not None:
                node = node.left if x[k, node.feature] < node.cut else node.right
            total[k] += node.leaf
    return total


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, penalty: float = 1.0) -> Node:
    """A regression tree on gradients: the split with the largest gain, whole-number cuts."""
    leaf = Node(leaf=round(-rate * g.sum() / (h.sum() + penalty) * 1_000_000))
    if depth == 0 or len(x) < 8:
        return leaf
    best = (1e-6, -1, 0)
    base = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts):
            gain = gs[cuts] ** 2 / (hs[cuts] + penalty) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + penalty) - base
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, int(v[cuts[k] + 1]))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] < best[2]
    return Node(best[1], best[2], grow(x[low], g[low], h[low], depth - 1, rate), grow(x[~low], g[~low], h[~low], depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> tuple[Node, ...]:
    trees: list[Node] = []
    score = np.zeros(len(y), np.int64)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score / 1e6))
        trees.append(grow(x, p - y, p * (1 - p), depth, rate))
        score += predict((trees[-1],), x)
    return tuple(trees)


def candidate_features(kind: str, value: str, before: str, after: str) -> list[int]:
    """The features of one candidate, in the order of ``FEATURES``."""
    letters = sum(c.isascii() and c.isalpha() for c in value)
    return [
        int(kind == "secret"),
        len(value),
        sum(c in "0123456789" for c in value),
        letters,
        value.count(" ") + value.count("-"),
        int(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) is not None),
        len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", value)),
        sum("A" <= c <= "Z" for c in value),
        int(re.search(CUES, before[-CONTEXT:].lower()) is not None),
        int(re.search(ASSIGNED, before) is not None),
        int(re.search(r"[A-Za-z0-9_@.%+/-]$", before) is not None or re.match(r"[A-Za-z0-9_@%+/=-]|[.][A-Za-z0-9]", after) is not None),
        len(re.findall("[_/-]", value)),
    ]


def generated(rng: np.random.Generator, n: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates: leaked tokens and account numbers against look-alikes."""

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def of(chars: str, k: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), k))

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    word = lambda: of("aeioulnrst", int(rng.integers(3, 9)))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, marks = [], []
    for _ in range(n):
        cue = pick(*"token key secret password auth account card iban".split())
        lead = pick(f"{cue} = \"", f"{cue}: ", f"{cue}=", f"my {cue} is ", f"{word()} {word()} ", f"{word()}, ", "", f"{word()}. ")
        tail = pick(" ", ". ", "\" ", ", ", "", "\n")
        kind = int(rng.integers(15))
        glued_lead, glued_tail = pick(word(), "@", "x."), pick(word(), "@x", ".com")
        if kind == 0:
            row, mark = ("secret", of(pick("0123456789abcdef", "0123456789ABCDEF"), pick(32, 40, 48, 64, 20, 24)), lead, tail), 1
        elif kind == 1:
            row, mark = ("secret", of(alnum, int(rng.integers(20, 50))), lead, tail), 1
        elif kind == 2:
            row, mark = ("secret", pick("sk_live_", "ghp_", "AKIA", "xoxb-", "") + of(alnum, int(rng.integers(16, 40))), lead, tail), 1
        elif kind == 3:
            row, mark = ("account", digits(pick(16, 16, 16, 15, 14, 13, 19, 18)), lead, tail), 1
        elif kind == 4:
            row, mark = ("account", pick("-", " ").join(digits(4) for _ in range(4)), lead, tail), 1
        elif kind == 5:
            row, mark = ("secret", "-".join(word() for _ in range(int(rng.integers(3, 7)))) + pick("-1", "-2024", "2", "-10-" + word()), lead, tail), 0
        elif kind == 6:
            row, mark = ("secret", "/".join(word() for _ in range(int(rng.integers(3, 7)))) + pick("/v2", "/1", "/x86_64"), lead, tail), 0
        elif kind == 7:
            row, mark = ("secret", word() + word() + word() + digits(int(rng.integers(1, 5))), lead, tail), 0
        elif kind == 8:
            row, mark = ("account", pick(f"20{digits(2)}-0{digits(1)}-1{digits(1)} 1{digits(1)}-{digits(2)}-{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}-1{digits(5)}"), lead, tail), 0
        elif kind == 9:
            row, mark = ("account", pick(" ", "-").join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(6, 16)))), lead, tail), 0
        elif kind == 10:
            row, mark = ("account", digits(pick(13, 16, 19)), *pick((lead + glued_lead, tail), (lead, glued_tail))), 0
        elif kind == 11:
            country = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2)
            groups = [pick(digits(4), digits(4), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4)) if not k else digits(4) for k in range(int(rng.integers(3, 7)))]
            row, mark = ("account", country + digits(2) + (gap := pick(" ", "")) + gap.join(groups) + pick("", gap + digits(2)), lead, tail), 1
        elif kind == 12:
            shout = lambda: of("AEIOULNRSTBCD", 4)
            row, mark = ("account", of("ABCDEFG", 2) + digits(2) + (gap := pick(" ", "")) + gap.join(shout() for _ in range(int(rng.integers(2, 5)))), lead, tail), 0
        elif kind == 13:
            row, mark = ("account", of("ABCDEFG", 2) + digits(2) + "".join(digits(4) for _ in range(4)), *pick((lead + glued_lead, tail), (lead, glued_tail))), 0
        else:
            row, mark = ("secret", of(alnum, int(rng.integers(16, 40))), *pick((lead + "@", tail), (lead, "@" + word()), (lead + word() + ".", tail))), 0
        rows.append(candidate_features(*row))
        marks.append(mark)
    return np.array(rows, np.int64), np.array(marks, np.int64)


@lru_cache(maxsize=2)
def fitted(seed: int = 3, precision: float = 0.98) -> tuple[tuple[Node, ...], int]:
    """Trees, and the least score at which held-out generated candidates are right often enough."""
    x, y = generated(np.random.default_rng(seed))
    held = np.arange(len(y)) % 4 == 0
    trees = boost(x[~held], y[~held])
    score, truth = predict(trees, x[held]), y[held]
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.flatnonzero(right >= precision)
    cut = int(score[order[last[-1]]]) if len(last) else int(score.max()) + 1
    return trees, max(cut, 0)


# --------------------------------------------------------------------------- columns


def running_sum(values: Column) -> Column:
    """Prefix sums of an array of whole numbers in n log n steps, by doubling distances."""

    def doubled(v: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < F.size(v))
        return F.aggregate(steps, v, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))

    return let(values, doubled)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<value, start, before, after>> of the leftmost non-overlapping matches."""

    def placed(s: Column) -> Column:
        gaps, hits = s["gaps"], s["hits"]
        starts = running_sum(F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))))
        return let(starts, lambda at: F.transform(hits, lambda h, i: F.struct(h.alias("value"), at[i].alias("start"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(2)).alias("after"))))

    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)
    return F.when(gate, found).otherwise(F.array().cast("array<struct<value:string,start:int,before:string,after:string>>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""

    def total(d: Column) -> Column:
        each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(digits_of(value), total)


def in_range(value: Column, low: int, high: int) -> Column:
    return F.length(digits_of(value)).between(low, high)


def parts_of(x: Column) -> Column:
    """The runs of whole groups inside a match of the card pattern that are a card number each; they may overlap."""

    def windows(g: Column) -> Column:
        starts = running_sum(F.transform(g, lambda y, i: F.when(i == 0, F.lit(0)).otherwise(F.length(F.get(g, i - 1)) + 1)))

        def placed(at: Column) -> Column:
            def ends(i: Column) -> Column:
                spots = F.sequence(i, F.least(F.size(g) - 1, i + 18))
                # Between groups there is one character, all others are digits.
                long = F.filter(spots, lambda j: (at[j] + F.length(g[j]) - at[i] - (j - i)).between(13, 19))
                return F.transform(long, lambda j: F.struct(at[i].alias("a"), (at[j] + F.length(g[j])).alias("b")))

            pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), ends))
            cut = F.transform(
                pairs,
                lambda y: F.struct(
                    F.substr(x["value"], y["a"] + 1, y["b"] - y["a"]).alias("value"),
                    (x["start"] + y["a"]).alias("start"),
                    F.right(F.concat(x["before"], F.left(x["value"], y["a"])), F.lit(CONTEXT)).alias("before"),
                    F.left(F.concat(F.substr(x["value"], y["b"] + 1), x["after"]), F.lit(2)).alias("after"),
                ),
            )
            return F.filter(cut, lambda y: luhn(y["value"]))

        return let(starts, placed)

    return let(F.split(x["value"], "[ -]"), windows)


def span(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("s"), (x["start"] + F.length(x["value"])).alias("e"))


def feature_columns(kind: str, x: Column) -> dict[str, Column]:
    value, before, after = x["value"], x["before"], x["after"]
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    flag = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    return {
        "is_secret": F.lit(int(kind == "secret")),
        "n_chars": F.length(value),
        "n_digits": count("[0-9]"),
        "n_letters": count("[A-Za-z]"),
        "n_gaps": count("[ -]"),
        "is_hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "n_switches": F.regexp_count(F.regexp_replace(value, "([0-9])(?=[A-Za-z])|([A-Za-z])(?=[0-9])", "$1$2\u0001"), F.lit("\u0001")),
        "n_upper": count("[A-Z]"),
        "cued": flag(F.lower(before).rlike(CUES)),
        "assigned": flag(before.rlike(ASSIGNED)),
        "glued": flag(before.rlike(r"[A-Za-z0-9_@.%+/-]$") | after.rlike(r"^(?:[A-Za-z0-9_@%+/=-]|[.][A-Za-z0-9])")),
        "n_dashes": count("[_/-]"),
    }


def accepted(kind: str, x: Column) -> Column:
    trees, cut = fitted()
    columns = feature_columns(kind, x)

    def scored(f: Column) -> Column:
        each = [render(t, lambda name: f[name], lambda v, c, a, b: F.when(v < c, a).otherwise(b), lambda leaf: F.lit(leaf)) for t in trees]
        total = each[0]
        for e in each[1:]:
            total = total + e
        return total >= cut

    return let(F.struct(*(c.alias(n) for n, c in columns.items())), scored)


def with_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``text_`` (null read as empty) and ``spans_``: array<struct<k, s, e>> sorted by kind, start and end."""
    text = F.col("text_")
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    rows = docs.select(*keep, text_or_empty().alias("text_"))
    rows = rows.select("*", matches(text, PATTERNS["email"], has_at).alias("email"), matches(text, PATTERNS["ip"], has_digit).alias("ip"), matches(text, PATTERNS["card"], has_digit).alias("card"), matches(text, PATTERNS["phone"], F.contains(text, F.lit("+"))).alias("phone"), matches(text, PATTERNS["secret"], has_digit).alias("secret"), matches(text, PATTERNS["iban"], has_digit).alias("iban"))
    good_ip = lambda x: ~F.exists(F.split(x["value"], "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    is_card = lambda x: in_range(x["value"], 13, 19) & luhn(x["value"])
    long_runs = F.filter("card", lambda x: F.length(digits_of(x["value"])) > 19)
    rows = rows.withColumn("inner", F.flatten(F.transform(long_runs, parts_of)))
    accounts = F.concat(
        F.transform(F.filter("card", lambda x: in_range(x["value"], 12, 24) & ~is_card(x) & accepted("account", x)), span("account")),
        F.transform(F.filter("inner", lambda x: accepted("account", x)), span("account")),
        F.transform(F.filter("iban", lambda x: accepted("account", x)), span("account")),
    )
    parts = [
        F.transform("email", span("email")),
        F.transform(F.filter("ip", good_ip), span("ip")),
        F.transform(F.filter("card", is_card), span("card")),
        F.transform(F.filter("phone", lambda x: in_range(x["value"], 9, 15)), span("phone")),
        F.array_sort(F.array_distinct(accounts)),
        F.transform(F.filter("secret", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & accepted("secret", x)), span("secret")),
    ]
    return rows.select(*keep, "text_", F.concat(*parts).alias("spans_"))


def personal_data(docs: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans of every document."""
    name = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["k"]], x["s"], x["e"])), ",")
    rows = with_spans(docs, "doc_id")
    number = lambda k: F.size(F.filter("spans_", lambda x: x["k"] == k))
    counts = [number(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    counts.append(F.size("spans_").cast("long").alias("n_spans"))
    base = F.filter("spans_", lambda x: x["k"] < len(BASE))
    return rows.select("doc_id", *counts[: len(BASE)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans_").alias("spans"), *counts[len(BASE) :])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one mark.

    ``n_chars``, where it exists, is the new length; a null text stays null.
    """
    rows = with_spans(packed(docs, F.col("text")), "row")
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(spans: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fresh = x["s"] >= acc["at"]
            out = F.when(fresh, F.concat(acc["out"], F.substr(F.col("text_"), acc["at"] + 1, x["s"] - acc["at"]), name[x["k"]])).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(F.col("text_"), acc["at"] + 1)))

    ordered = F.sort_array(F.transform("spans_", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    text = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).when(F.size("spans_") == 0, F.col("text_")).otherwise(let(ordered, rebuilt))
    rows = rows.withColumn("new_", text)
    changed = {"text": F.col("new_")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_").cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, docs.columns, **changed)


# --------------------------------------------------------------------------- oracle


def oracle() -> str:
    """The query as DuckDB SQL; patterns without lookbehind, the same trees."""
    trees, cut = fitted()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    total = " + ".join(f"({render(t, lambda n: n, lambda v, c, a, b: f'case when {v} < {c} then {a} else {b} end', str)})" for t in trees)
    kinds = []
    for kind in ("email", "ip", "card", "phone", "secret", "iban"):
        p = quote(PLAIN_PATTERNS[kind])
        kinds.append(f"select rid, {quote(kind)} as pattern, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}) as hits from d")
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({" union all ".join(kinds)}),
p as (select rid, pattern, gaps, hits, generate_subscripts(hits, 1) as i, unnest(hits) as value from m),
h as (
  select rid, pattern, i, value, right(gaps[i], {CONTEXT}) as before, left(gaps[i + 1], 2) as after,
    (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::bigint as s
  from p
),
runs as (select *, string_split_regex(value, '[ -]') as g from h where pattern = 'card' and length(regexp_replace(value, '[^0-9]', '', 'g')) > 19),
firsts as (select *, unnest(range(len(g))) as x from runs),
pairs as (select *, unnest(range(x, least(len(g), x + 19))) as y from firsts),
cuts as (select *, coalesce(list_sum(list_transform(g[1:x], lambda z: length(z) + 1)), 0)::bigint as a, list_sum(list_transform(g[1:y + 1], lambda z: length(z) + 1))::bigint - 1 as b from pairs),
every as (
  select rid, pattern, value, before, after, s from h
  union all select rid, 'inner', substr(value, a + 1, b - a), right(before || left(value, a), {CONTEXT}), left(substr(value, b + 1) || after, 2), s + a
    from cuts where b - a - (y - x) between 13 and 19
),
v as (
  select *, s + length(value) as e, regexp_replace(value, '[^0-9]', '', 'g') as dg,
    pattern = 'secret' as sec from every
),
l as (
  select *, length(dg) between 13 and 19 and
    list_sum(list_transform(string_split(reverse(dg), ''), lambda c, k: case when c = '' then 0 when k % 2 = 1 then c::int else (c::int * 2) % 10 + c::int // 5 end)) % 10 = 0 as luhn
  from v where pattern in ('card', 'secret', 'inner', 'iban')
),
f as (
  select rid, pattern, s, e, value, dg, luhn,
    case when sec then 1 else 0 end as is_secret, length(value) as n_chars, length(dg) as n_digits,
    length(regexp_replace(value, '[^A-Za-z]', '', 'g')) as n_letters, length(regexp_replace(value, '[^ -]', '', 'g')) as n_gaps,
    case when regexp_matches(value, '^(?:[0-9a-f]+|[0-9A-F]+)$') then 1 else 0 end as is_hex,
    length(regexp_replace(regexp_replace(value, '([0-9])([A-Za-z])', '\1' || chr(1) || '\2', 'g'), '([A-Za-z])([0-9])', '\1' || chr(1) || '\2', 'g')) - length(value) as n_switches,
    length(regexp_replace(value, '[^A-Z]', '', 'g')) as n_upper,
    case when regexp_matches(lower(before), {quote(CUES)}) then 1 else 0 end as cued,
    case when regexp_matches(before, {quote(ASSIGNED)}) then 1 else 0 end as assigned,
    case when regexp_matches(before, '[A-Za-z0-9_@.%+/-]$') or regexp_matches(after, '^(?:[A-Za-z0-9_@%+/=-]|[.][A-Za-z0-9])') then 1 else 0 end as glued,
    length(regexp_replace(value, '[^_/-]', '', 'g')) as n_dashes
  from l
),
spans as (
  select rid, 0 as k, s, e from v where pattern = 'email'
  union all select rid, 1, s, e from v where pattern = 'ip' and list_max(list_transform(string_split(value, '.'), lambda x: x::hugeint)) <= 255
  union all select rid, 2, s, e from l where pattern = 'card' and luhn
  union all select rid, 3, s, e from v where pattern = 'phone' and length(dg) between 9 and 15
  union select rid, case when pattern = 'secret' then 5 else 4 end, s, e from f
    where ((pattern = 'card' and n_digits between 12 and 24 and not luhn) or (pattern = 'inner' and luhn) or pattern = 'iban' or (pattern = 'secret' and n_digits > 0 and n_letters > 0))
      and {total} >= {cut}
),
t as (select rid, k, s, e, {str(list(KINDS))}[k + 1] || ':' || s || ':' || e as x from spans),
g as (
  select rid, string_agg(x, ',' order by k, s, e) as spans, string_agg(x, ',' order by k, s, e) filter (k < {len(BASE)}) as base,
    count(*) as n_spans, {", ".join(f"count(*) filter (k = {k}) as n_{kind}" for k, kind in enumerate(KINDS))}
  from t group by rid
)
select doc_id, {", ".join(f"coalesce(n_{kind}, 0)::bigint as n_{kind}" for kind in BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  {", ".join(f"coalesce(n_{kind}, 0)::bigint as n_{kind}" for kind in (*ADDED, "spans"))}
from d left join g using (rid)
"""
