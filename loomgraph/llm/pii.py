"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are spans of four kinds.  Base candidates match the strict patterns and pass their tests; misses match and fail
(wrong check digits, say), and stand for what isn't personal data; wider ones match looser patterns (addresses written with "at" and "dot", telephone and card numbers without their marks).  Three kinds of labelers vote on
each candidate, yes, no or not at all: patterns (does the strict one hold), gazetteers (known top-level domains, calling
codes, issuer prefixes) and context (words such as "call" or "card" just before it).  Expectation-maximisation over the
counts of the vote patterns estimates how reliable each labeler is and how likely each pattern is to be personal data.
These posteriors train the final span classifier, a logistic regression over what is seen of the span, which decides on
the wider candidates.  Base spans stay whatever it says.

Votes and features take few values, so EM and the regression work on a table of pattern counts that has a fixed largest
size however many documents there are.

Matching keeps leftmost, non-overlapping semantics while staying linear in the text: runs are taken possessively and
begin only where a run begins, or where the last match ended.  Matches are wrapped in two private-use characters, which
are first replaced in the text by another character outside all patterns, and positions are sums of lengths.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
_OPEN, _CLOSE, _STAND_IN = "\ue000", "\ue001", "\ue002"

# The four base patterns, as linear-time equivalents.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, of spans that the base ones leave out.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[ ]?[(\[](?:at|AT)[)\]][ ]?[A-Za-z0-9-]{1,63}+(?:[ ]?[(\[](?:dot|DOT)[)\]][ ]?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[.-][0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
}
#: Gazetteers and context words, by kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|io|de|fr|uk|es|it|nl|eu|info|biz)$",
    "ip": r"^(?:10\.|127\.|172\.|192\.|[1-9][0-9]{0,2}\.|2[0-9A-Fa-f]{3}:|fe80:|fd)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|20|27|3|4|5|6|8|9)|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)[^A-Za-z]{0,3}(?:[a-z]{1,4} ){0,2}$",
    "ip": r"(?i)(?:\bip|host|server|address|login|from)[^A-Za-z]{0,3}(?:[a-z]{1,4} ){0,2}$",
    "card": r"(?i)(?:card|visa|credit|payment|account|number)[^A-Za-z]{0,3}(?:[a-z]{1,4} ){0,2}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell|contact|number)[^A-Za-z]{0,3}(?:[a-z]{1,4} ){0,2}$",
}
LABELERS = ("strict", "shape", "gazetteer", "context")
FEATURES = ("wide", "shape", "gazetteer", "context", "marked", "long")
_RUN = 64
_EMPTY = "array<struct<start:int,end:int,match:string,before:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _parts(text: Column, pattern: str, possible: Column) -> Column:
    """The text cut before each match of a pattern, the end of each match marked; null where ``possible`` is false."""
    clean = F.translate(text, _OPEN + _CLOSE, _STAND_IN * 2)
    wrapped = "(" + pattern.replace("\\1", "\\2") + ")"
    return F.when(possible, F.split(F.regexp_replace(clean, wrapped, f"{_OPEN}$1{_CLOSE}"), _OPEN))


def _spans(parts: Column, counts=None, context: int = 24) -> Column:
    """The matches in what _parts() returns for which ``counts`` holds, with their positions in code points and what
    stands before each.  Other matches only move the position on, and matches are listed in runs of _RUN, as a list is
    copied for each match that joins it."""

    def end_of(s: Column) -> Column:
        return F.substring(s, F.greatest(F.length(s) - context + 1, F.lit(1)), F.lit(context))

    def step(acc: Column, part: Column) -> Column:
        match, start = F.substring_index(part, _CLOSE, 1), acc["at"]
        span = F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), acc["before"].alias("before"))
        rest = F.substring(part, F.length(match) + 2, F.length(part))
        more = F.concat(acc["spans"], F.array(span))
        kept = more if counts is None else F.when(counts(match), more).otherwise(acc["spans"])
        return F.struct((start + F.length(part) - 1).alias("at"), end_of(rest).alias("before"), kept.alias("spans"))

    none, first = F.array().cast(_EMPTY), F.element_at(parts, 1)
    each = F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / _RUN).cast("int"))
    runs = F.transform(each, lambda r: F.struct(F.slice(parts, r * _RUN + 2, _RUN).alias("parts"), end_of(F.substring_index(F.element_at(parts, r * _RUN + 1), _CLOSE, -1)).alias("before")))
    lengths = F.transform(runs, lambda r: F.aggregate(r["parts"], F.lit(0), lambda n, part: n + F.length(part) - 1))
    starts = F.aggregate(lengths, F.array(F.length(first)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)), lambda at: F.slice(at, 1, F.size(at) - 1))

    def spans_of(run: Column, start: Column) -> Column:
        return F.aggregate(run["parts"], F.struct(start.alias("at"), run["before"].alias("before"), none.alias("spans")), step, lambda acc: acc["spans"])

    return F.when(F.size(parts) > 1, F.flatten(F.zip_with(runs, starts, spans_of))).otherwise(none)


def _possible(kind: str, text: Column) -> Column:
    """A cheap condition that any match of the base pattern meets."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}[kind]


def _possible_wide(kind: str, text: Column) -> Column:
    return {
        "email": text.rlike("[(\\[](?:at|AT)[)\\]]"),
        "ip": text.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
        "card": text.rlike("[0-9]{4}[ -]?[0-9]{4}"),
        "phone": text.rlike("[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    }[kind]


def _passing(kind: str):
    return lambda match: passes(kind, match)


def _near_miss(kind: str):
    """Whether a match has the form of its kind but fails the test."""

    def miss(match: Column) -> Column:
        has_form = F.length(_digits(match)).between(13, 19) if kind == "card" else F.lit(kind != "email")
        return has_form & ~passes(kind, match)

    return miss


def _apart_from(arrays: list[str]):
    """Whether a span overlaps none of these arrays' spans, which are sorted and don't overlap: of each array the last
    span that starts before its end is found by halving."""

    def overlaps(t: str, s: Column) -> Column:
        steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
        ahead = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(t, at + k - 1)["start"] < s["end"], at + k).otherwise(at))
        return F.coalesce(F.get(t, ahead - 1)["end"] > s["start"], F.lit(False))

    return lambda s: ~reduce(Column.__or__, (overlaps(t, s) for t in arrays))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``base_<kind>``, ``miss_<kind>`` and ``wide_<kind>``: arrays of spans.  Misses have the form of a base span
    and fail its test.  A wide span that overlaps a base span of any kind, or a wide span of an earlier kind, is left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = {f"__base_{k}": _parts(text, BASE[k], _possible(k, text)) for k in KINDS} | {f"__wide_{k}": _parts(text, WIDE[k], _possible_wide(k, text)) for k in KINDS}
    out = docs.withColumns(cut)
    out = out.withColumns({f"base_{k}": _spans(F.col(f"__base_{k}"), _passing(k)) for k in KINDS} | {f"miss_{k}": _spans(F.col(f"__base_{k}"), _near_miss(k)) for k in KINDS[1:]})
    taken = [f"base_{k}" for k in KINDS]
    for kind in KINDS:
        free = F.filter(_spans(F.col(f"__wide_{kind}")), _apart_from(taken))
        out = out.withColumn(f"wide_{kind}", free)
        taken.append(f"wide_{kind}")
    out = out.drop(*cut)
    return out


def _votes(kind: str, form: str, s: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1, 0, or -1 for none."""
    match, digits = s["match"], _digits(s["match"])
    shape = {
        "email": match.rlike("[A-Za-z]"),
        "ip": match.rlike(":") | passes("ip", match),
        "card": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15) | match.rlike("^[(]"),
    }[kind]
    yes = lambda c: c.cast("int")
    return {
        "strict": F.lit({"base": 1, "miss": 0, "wide": -1}[form]),
        "shape": yes(shape),
        "gazetteer": yes(match.rlike(GAZETTEER[kind])),
        "context": F.when(s["before"].rlike(CONTEXT[kind]), 1).otherwise(-1),
    }


def _features(kind: str, form: str, s: Column) -> dict[str, Column]:
    v = _votes(kind, form, s)
    return {
        "wide": F.lit(int(form == "wide")),
        "shape": v["shape"],
        "gazetteer": v["gazetteer"],
        "context": (v["context"] == 1).cast("int"),
        "marked": s["match"].rlike("[-+() @:\\[\\]]").cast("int"),
        "long": (F.length(s["match"]) > 16).cast("int"),
    }


def em(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]], float]:
    """Posteriors of the vote patterns, each labeler's rates of yes on true and on false spans, and the share of true
    ones.  A labeler that doesn't vote says nothing.  The rates start where labelers are better than chance."""
    width = len(next(iter(counts), ()))
    rates, prior = [(0.8, 0.3)] * width, 0.7

    def posterior(votes: tuple[int, ...]) -> float:
        yes, no = math.log(prior), math.log(1 - prior)
        for v, (a, b) in zip(votes, rates, strict=True):
            if v >= 0:
                yes += math.log(a if v else 1 - a)
                no += math.log(b if v else 1 - b)
        return 1 / (1 + math.exp(min(700.0, no - yes)))

    for _ in range(rounds):
        p = {v: posterior(v) for v in counts}
        true = sum(n * p[v] for v, n in counts.items())
        total = sum(counts.values())
        prior = (true + 7) / (total + 10)
        rates = []
        for j in range(width):
            a = sum(n * p[v] for v, n in counts.items() if v[j] == 1) + 4
            a_all = sum(n * p[v] for v, n in counts.items() if v[j] >= 0) + 5
            b = sum(n * (1 - p[v]) for v, n in counts.items() if v[j] == 1) + 1.5
            b_all = sum(n * (1 - p[v]) for v, n in counts.items() if v[j] >= 0) + 5
            rates.append((a / a_all, b / b_all))
    return {v: posterior(v) for v in counts}, rates, prior


def logistic(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 400, ridge: float = 1.0) -> list[float]:
    """Weights (the intercept last) of a logistic regression on ``(features, number of spans, mean posterior)``."""
    width = len(rows[0][0]) if rows else len(FEATURES)
    w, total = [0.0] * (width + 1), sum(n for _, n, _ in rows) or 1.0
    for _ in range(steps):
        g = [ridge / total * x for x in w]
        for f, n, y in rows:
            x = (*f, 1)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, b in enumerate(x):
                g[j] += n / total * (p - y) * b
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(found: DataFrame) -> dict[str, list[float]]:
    """The span classifier of each kind, from the candidates of all documents, near misses included.  What reaches the
    driver is a count for each kind, vote pattern and feature vector: at most 4 * 3**4 * 2**6 rows."""
    spans = []
    for kind, form in itertools.product(KINDS, ("base", "miss", "wide")):
        if f"{form}_{kind}" not in found.columns:
            continue
        one = found.select(F.explode(f"{form}_{kind}").alias("s"))
        votes, features = _votes(kind, form, F.col("s")), _features(kind, form, F.col("s"))
        spans.append(one.select(F.lit(kind).alias("kind"), *(votes[x].alias(f"v_{x}") for x in LABELERS), *(features[x].alias(f"f_{x}") for x in FEATURES)))
    keys = ["kind", *(f"v_{x}" for x in LABELERS), *(f"f_{x}" for x in FEATURES)]
    table = reduce(DataFrame.unionByName, spans).groupBy(*keys).count().collect()
    out = {}
    for kind in KINDS:
        own = sorted((tuple(r[f"v_{x}"] for x in LABELERS), tuple(r[f"f_{x}"] for x in FEATURES), r["count"]) for r in table if r["kind"] == kind)
        counts: dict[tuple[int, ...], float] = {}
        for v, _, n in own:
            counts[v] = counts.get(v, 0.0) + n
        posterior, _, _ = em(counts)
        grouped: dict[tuple[int, ...], list[float]] = {}
        for v, f, n in own:
            g = grouped.setdefault(f, [0.0, 0.0])
            g[0] += n
            g[1] += n * posterior[v]
        out[kind] = logistic([(f, n, s / n) for f, (n, s) in sorted(grouped.items())])
    return out


def detect(docs: DataFrame, text_col: str = "text", keep: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """docs (the columns to carry, all by default) with ``base`` and ``spans``: arrays of ``(kind, start, end)``, in code points, end exclusive, by kind and start.

    base has the matches of the base patterns that pass their tests; spans has these and the wide candidates to which the
    trained classifier gives ``keep`` or more.  Null texts count as empty and have no spans.
    """
    columns = docs.columns if carry is None else carry
    wrapped = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("__text"))
    found = materialize(candidates(wrapped, "__text").drop("__text"), "pii-candidates")
    weights = fit(found)
    kinds = dict(zip(KINDS, range(4), strict=True))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.struct(F.lit(kinds[kind]).alias("order"), s["start"].alias("start"), s["end"].alias("end")))

    def likely(kind: str) -> Column:
        w = weights[kind]

        def test(s: Column) -> Column:
            f = _features(kind, "wide", s)
            z = reduce(Column.__add__, (F.lit(a) * f[x] for a, x in zip(w[:-1], FEATURES, strict=True)), F.lit(w[-1]))
            return z >= math.log(keep / (1 - keep))

        return F.filter(f"wide_{kind}", test)

    base = F.concat(*(named(k, F.col(f"base_{k}")) for k in KINDS))
    spans = F.array_sort(F.concat(base, *(named(k, likely(k)) for k in KINDS)))

    def shown(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return found.select("row.*", shown(base).alias("base"), shown(spans).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row of docs: counts and digest of the base
    spans, and all spans as text.  Repeated rows stay repeated; an empty table gives an empty result; other columns play
    no part."""
    found = detect(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), carry=["doc_id"])
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with each span of personal data replaced by its kind in brackets; overlapping spans become one,
    of the kind that starts first.  length_col, where docs has it, is the new length.  Null texts stay null, repeated rows
    stay repeated, an empty table gives an empty result."""
    others = [c for c in docs.columns if c != text_col] or [F.lit(True).alias("alone")]
    inner = docs.select(F.struct(*others).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = detect(inner).select("doc", "text", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        start, end, kind = s["start"], s["end"], s["kind"]
        apart = start >= acc["at"]
        between = F.substring(F.col("text"), acc["at"] + 1, start - acc["at"])
        return F.struct(
            F.greatest(acc["at"], end).alias("at"),
            F.when(apart, F.concat(acc["out"], between, F.lit("["), F.upper(kind), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("s", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = F.when(F.size("s") > 0, done).otherwise(F.col("text"))
    out = found.select("doc", new.alias("new")).select(*(F.col("doc")[c].alias(c) if c != text_col else F.col("new").alias(c) for c in docs.columns))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast("long"))
    return out.select(*docs.columns)
