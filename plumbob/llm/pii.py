"""Personal data in texts, by labelers that vote and a classifier trained on their votes.

Patterns give candidate spans. Valid e-mail addresses, IP addresses, card numbers
and phone numbers are spans by definition; of the other candidates (spelled-out
addresses, national phone numbers, names after a title, account and identity
numbers, secrets) five labelers each vote for, against or not: format, shape,
gazetteer, context and edges. Expectation-maximisation over the counts of their
vote patterns estimates how reliable each is with each kind and how likely each
pattern is personal data; a naive Bayes classifier over features of the span is
trained on these probabilities and decides. Valid spans, and matches that fail
their definition, are examples of known truth in both; what overlaps a valid span
is no candidate, and a labeler that does not vote says nothing.

Texts are read by DataFrame expressions alone. Only candidates leave the scan,
only counts of vote patterns and feature values, whose number the code bounds,
reach the driver, and nothing is shuffled but these counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, stored

KINDS = ("email", "ip", "card", "phone", "iban", "name", "secret", "ssn")
BASE_KINDS = KINDS[:4]
LABELERS = ("format", "shape", "gazetteer", "context", "edges")
#: Candidates that are no valid base span become spans from this probability on.
MIN_PROBABILITY = 0.9
ROUNDS = 30
#: Votes at the rate of all kinds together that a kind's own rate starts with.
PRIOR = 10.0
LEFT, RIGHT = 32, 12

# Matches start only where the greedy pattern could start first, and loops never
# give back, so long runs of one class are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Kind, pattern, and a cheap condition without which a text holds no match.
PATTERNS = (
    ("email", EMAIL, "@"),
    ("ip", IP, "digit"),
    ("card", CARD, "digit"),
    ("phone", PHONE, "+"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,64}+){1,4}+", "at"),
    ("phone", r"(?<![0-9A-Za-z+.(-])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", "digit"),
    ("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "digit"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "digit"),
    ("name", r"(?<![0-9A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-zà-ÿ][\p{L}\p{M}]*+(?: [A-Z][a-zà-ÿ][\p{L}\p{M}]*+)?", "title"),
    (
        "secret",
        r"(?i)(?<![0-9A-Za-z_])(?:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key) ?[:=] ?[\"']?[0-9A-Za-z_/+.-]{8,}+|(?-i:AKIA[0-9A-Z]{16})(?![0-9A-Za-z]))",
        "secret",
    ),
)
CONDITIONS = {
    "digit": "[0-9]",
    "at": r"[(\[]at[)\]]",
    "title": r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]",
    "secret": r"(?i)password|passwd|pwd|secret|token|key|AKIA",
}

# Fixed values of the gazetteers and of the context labeler.
DOMAINS = "com org net edu gov int info biz io co de fr es it uk us eu ch at nl be pl se no fi dk pt br ca au jp cn in ru"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = "^[3456]"
RESERVED = r"^0*(?:0|10|127|255)\.|^0*192\.0*168\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\."
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Anna Maria Peter Paul Hans Klaus Jean Pierre Marie Sophie Carlos Juan Jose Luis Ana Laura Elena Marco Luca Giulia"
)
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM"
NEAR = {
    "email": "e-?mail|contact|write|reach|address|mailto|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|client|from",
    "card": "card|visa|master|amex|credit|debit|payment|tarjeta|karte|carte",
    "phone": r"phone|\btel\b|call|mobile|cell|fax|contact|whatsapp",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "name": "contact|patient|client|dear|by|from|signed",
    "secret": "password|token|key|secret|credential|login",
    "ssn": r"\bssn\b|social|security|identity",
}
FAR = r"(?i)(?:version|release|isbn|issn|order|invoice|total|price|figure|section|chapter|article no|doi|build)\W{0,3}$"

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string,base:boolean>"


def _any(words: str) -> str:
    return "|".join(words.split())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.reverse(_digits(value))
    doubled = F.translate(F.regexp_replace(backwards, "(.)(.)?", "$2"), "0123456789", "0246813579")
    digits = F.concat(F.regexp_replace(backwards, "(.)(.)?", "$1"), doubled)
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, d: s + F.coalesce(d.try_cast("int"), F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_candidates(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` and an array ``name`` of candidate spans with their places in code points, by pattern and start."""
    t = _fresh(df, f"{name}_text")
    df = df.withColumn(t, F.coalesce(text.cast("string"), F.lit("")))
    conditions = {}
    for key, pattern in CONDITIONS.items():
        conditions[key] = _fresh(df, f"{name}_{key}")
        df = df.withColumn(conditions[key], F.col(t).rlike(pattern))
    found, used = [], [t, *conditions.values()]
    for i, (kind, pattern, condition) in enumerate(PATTERNS):
        hits, gaps = _fresh(df, f"{name}_hits{i}"), _fresh(df, f"{name}_gaps{i}")
        may = F.col(conditions[condition]) if condition in conditions else F.col(t).contains(condition)
        df = df.withColumn(hits, F.when(may, F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0))))
        df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(t), pattern, -1)))
        found.append(_spans(kind, i < len(BASE_KINDS), hits, gaps))
        used += [hits, gaps]
    valid = _fresh(df, f"{name}_valid")
    df = df.withColumn(name, F.concat(*found)).withColumn(valid, F.filter(name, lambda s: s["base"]))
    free = F.filter(name, lambda s: s["base"] | ~F.exists(valid, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.withColumn(name, F.when(F.size(valid) > 0, free).otherwise(F.col(name))).drop(*used, valid)


def _spans(kind: str, base: bool, hits: str, gaps: str) -> Column:
    """Places of matches, from the lengths of the matches and of the texts between them."""

    def step(state: Column, i: Column) -> Column:
        start = state["end"] + F.length(F.get(gaps, i)).cast("bigint")
        return F.struct(
            (start + F.length(F.get(hits, i))).alias("end"), F.concat(state["starts"], F.array(start)).alias("starts")
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step)["starts"]

    def span(start: Column, i: Column) -> Column:
        value = F.get(hits, i)
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
            F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right"),
            (_valid(kind, value) if base else F.lit(False)).alias("base"),
        )

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(hits) > 0, F.transform(starts, span).cast(f"array<{SPAN}>")).otherwise(none)


def failed(span: Column) -> Column:
    """Whether a span is a match of a base pattern that fails its definition."""
    kind, value = span["kind"], span["value"]
    short = value.startswith("+") & ~_valid("phone", value)
    return ~span["base"] & (kind.isin("ip", "card") | (kind == "phone") & short)


def votes(span: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 neither."""
    kind, value, left, right = span["kind"], span["value"], span["left"], span["right"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)

    def by_kind(cases: dict[str, Column]) -> Column:
        return reduce(lambda out, k: F.when(kind == k, cases[k]).otherwise(out), cases, none)

    def either(condition: Column) -> Column:
        return F.when(condition, yes).otherwise(no)

    domain = F.regexp_extract(value, r"([A-Za-z]+)$", 1)
    # Counted without references back, which a value of any length would overflow.
    distinct = reduce(lambda a, b: a + b, (value.contains(str(d)).cast("int") for d in range(10)))
    near = {k: F.when(left.rlike(f"(?i){w}"), yes).otherwise(none) for k, w in NEAR.items()}
    return {
        "format": by_kind({
            "email": F.when(span["base"], yes).otherwise(none),
            "ip": either(span["base"]),
            "card": either(span["base"]),
            "phone": F.when(span["base"], yes).when(failed(span), no).otherwise(none),
            "iban": either(F.length(F.regexp_replace(value, " ", "")).between(15, 34)),
            "secret": F.when(value.rlike("^(?=.*[0-9])(?=.*[A-Za-z]).{16}"), yes).otherwise(none),
            "ssn": either(~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")),
        }),
        "shape": F.when((distinct == 1) & (F.length(_digits(value)) > 1) | value.rlike(r"^[0-9](?:\.[0-9]){3}$"), no)
        .when(distinct >= 4, yes)
        .otherwise(none),
        "gazetteer": by_kind({
            "email": either(F.lower(domain).rlike(f"^(?:{_any(DOMAINS)})$")),
            "ip": F.when(value.rlike(RESERVED), no).otherwise(none),
            "card": either(value.rlike(ISSUERS)),
            "phone": F.when(~value.startswith("+"), none).otherwise(either(value.rlike(COUNTRY_CODES))),
            "iban": either(F.left(value, F.lit(2)).rlike(_any(IBAN_COUNTRIES))),
            "name": either(value.rlike(rf"\b(?:{_any(FIRST_NAMES)})\b")),
            "secret": F.when(value.rlike("AKIA|ghp_|sk-|xox"), yes).otherwise(none),
        }),
        "context": F.when(left.rlike(FAR), no).otherwise(by_kind(near)),
        "edges": either(~left.rlike(r"[\p{L}\p{N}_/.-]$") & ~right.rlike(r"^(?:[\p{L}\p{N}_/]|[.-][\p{L}\p{N}])")),
    }


def features(span: Column) -> dict[str, Column]:
    """What the classifier sees of a span; each has few values, and none where a labeler does not vote."""
    value = span["value"]

    def side(text: Column, pattern: str) -> Column:
        c = F.regexp_extract(text, pattern, 1)
        return (
            F.when(c == "", "end").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").when(c.rlike(r"\s"), "space").otherwise("sign")
        )

    return {
        "length": F.least(F.floor(F.length(value) / 4), F.lit(12)).cast("string"),
        "digits": F.least(F.floor(F.length(_digits(value)) / 2), F.lit(12)).cast("string"),
        "signs": F.least(F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), F.lit(8)).cast("string"),
        "before": side(span["left"], r"(?s)(.)$"),
        "after": side(span["right"], r"(?s)^(.)"),
        **{k: F.when(v != 0, v.cast("string")) for k, v in votes(span).items()},
    }


def reliabilities(patterns: dict[tuple, int], known: dict[tuple, bool] | None = None, rounds: int = ROUNDS) -> tuple[dict[tuple, float], dict]:
    """How likely each vote pattern ``(kind, vote, ...)`` is personal data, and each labeler's vote rates by truth.

    Expectation-maximisation from the majority's opinion on, with the truth of
    some patterns ``known``. A labeler has a rate of votes for, among its votes,
    per kind and truth, ``(name, kind, truth)``, drawn towards its rate over all
    kinds, ``(name, truth)``; a pattern without its vote says nothing of it. The
    share of truth of a kind is that of :func:`shares`.
    """
    known = known or {}
    truth = {p: float(known[p]) if p in known else 0.5 + 0.4 * max(-1, min(1, sum(p[1:]))) for p in patterns}
    kinds = sorted({p[0] for p in patterns})
    rates: dict = {}
    for _ in range(rounds):
        rates = {}
        for i, name in enumerate(LABELERS, 1):
            for y in (1, 0):
                n = {(k, v): 0.0 for k in kinds for v in (-1, 1)}
                for p, count in patterns.items():
                    if p[i]:
                        n[p[0], p[i]] += count * (truth[p] if y else 1 - truth[p])
                total = {v: 1.0 + sum(n[k, v] for k in kinds) for v in (-1, 1)}
                rates[name, y] = {v: total[v] / sum(total.values()) for v in (-1, 1)}
                for k in kinds:
                    own = {v: n[k, v] + PRIOR * rates[name, y][v] for v in (-1, 1)}
                    rates[name, k, y] = {v: own[v] / sum(own.values()) for v in (-1, 1)}
        share = shares(patterns, known, truth)
        for p in patterns:
            if p not in known:
                odds = math.log(share[p[0]] / (1 - share[p[0]]))
                odds += sum(math.log(rates[n, p[0], 1][v] / rates[n, p[0], 0][v]) for n, v in zip(LABELERS, p[1:]) if v)
                truth[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth, rates


def shares(patterns: dict[tuple, int], known: dict[tuple, bool], truth: dict[tuple, float]) -> dict[str, float]:
    """The share of truth of each kind's patterns that are not known, drawn towards that of the known ones."""
    found = {}
    for kind in {p[0] for p in patterns}:
        yes, n, sure, k = 0.0, 0, 1.0, 2.0
        for p, count in patterns.items():
            if p[0] == kind and p in known:
                sure, k = sure + count * truth[p], k + count
            elif p[0] == kind:
                yes, n = yes + count * truth[p], n + count
        weight = min(k, PRIOR)
        found[kind] = (weight * sure / k + yes) / (weight + n)
    return found


class SpanModel:
    """Log odds per kind and feature value, and their sum where a value is new."""

    def __init__(self, weights: dict[tuple[str, str, str], float], priors: dict[str, float]):
        self.weights, self.priors = weights, priors

    def odds(self, span: Column) -> Column:
        """Log odds that a span is personal data."""
        table = {f"{k}|{f}|{v}": w for (k, f, v), w in self.weights.items()} | {f"{k}||": w for k, w in self.priors.items()}
        if not table:
            return F.lit(-1.0)
        weights = F.create_map(*(x for k, w in sorted(table.items()) for x in (F.lit(k), F.lit(w))))
        keys = [F.concat(span["kind"], F.lit("||"))]
        keys += [F.concat(span["kind"], F.lit(f"|{f}|"), v) for f, v in features(span).items()]
        return reduce(lambda a, b: a + b, (F.coalesce(F.try_element_at(weights, k), F.lit(0.0)) for k in keys))


def train(candidates: DataFrame) -> SpanModel:
    """Train the classifier on all candidates: rows with an array ``spans``.

    Two small tables reach the driver: counts of vote patterns (at most 3^5 per
    kind) and weighted counts of feature values (at most 13 for each of ten
    features and kinds), however many candidates there are.
    """
    spans = candidates.select(F.explode("spans").alias("s")).select("s", *(v.alias(f"vote_{k}") for k, v in votes(F.col("s")).items()))
    names = [f"vote_{k}" for k in LABELERS]
    counted = spans.groupBy(F.col("s.kind").alias("kind"), *names).count().collect()
    patterns = {tuple(r[:-1]): r["count"] for r in counted}
    if not patterns:
        return SpanModel({}, {})
    # The format of the base kinds is their definition, where it has a vote.
    known = {p: p[1] > 0 for p in patterns if p[0] in BASE_KINDS and p[1]}
    truth, _ = reliabilities(patterns, known)
    table = F.create_map(*(x for p, y in sorted(truth.items()) for x in (F.lit("|".join(map(str, p))), F.lit(y))))
    likely = F.try_element_at(table, F.concat_ws("|", F.col("s.kind"), *(F.col(n).cast("string") for n in names)))
    values = F.array(*(F.struct(F.lit(f).alias("feature"), v.alias("value")) for f, v in features(F.col("s")).items()))
    rows = spans.select(F.col("s.kind").alias("kind"), likely.alias("likely"), F.inline(values)).where("value IS NOT NULL")
    sums = rows.groupBy("kind", "feature", "value").agg(F.sum("likely").alias("yes"), F.sum(1 - F.col("likely")).alias("no")).collect()
    total: dict[tuple[str, str], list[float]] = {}
    for r in sums:
        t = total.setdefault((r.kind, r.feature), [0.0, 0.0])
        t[0], t[1] = t[0] + r.yes, t[1] + r.no
    weights = {}
    for r in sums:
        # Drawn towards the value's share in the kind: a value is no evidence where the other side has no examples.
        yes, no = total[r.kind, r.feature]
        usual = PRIOR * (r.yes + r.no) / (yes + no)
        weights[r.kind, r.feature, r.value] = math.log((r.yes + usual) / (yes + PRIOR)) - math.log((r.no + usual) / (no + PRIOR))
    priors = {k: math.log(y / (1 - y)) for k, y in shares(patterns, known, truth).items()}
    return SpanModel(weights, priors)


def accepted(spans: Column, model: SpanModel, min_probability: float = MIN_PROBABILITY) -> Column:
    """The valid base spans and the likely candidates; by start, then kind as listed."""
    limit = math.log(min_probability / (1 - min_probability))
    base = F.filter(spans, lambda s: s["base"])
    likely = F.filter(spans, lambda s: ~s["base"] & ~failed(s) & (model.odds(s) >= limit))
    places = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    flat = F.transform(
        F.concat(base, likely),
        lambda s: F.struct(s["start"].alias("start"), F.element_at(places, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    return F.sort_array(F.array_distinct(flat))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_probability: float = MIN_PROBABILITY
) -> DataFrame:
    """One row per document: ``doc_id``, counts of valid base spans, ``base_sha256`` over their list, and all ``spans``.

    A null text is empty. Places are in code points, ends exclusive. Repeated
    rows and null ids stay, other columns are ignored, and the classifier is
    trained on the candidates of the whole table.
    """
    slim = df.select(as_long(id_column).alias("doc_id"), ref(text_column).alias("text"))
    found = stored(with_candidates(slim, F.col("text"), "spans").select("doc_id", "spans"), "personal")
    model = train(found)
    rows = found.select("doc_id", accepted(F.col("spans"), model, min_probability).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    rows = rows.withColumn("b", base)

    def count(kind: str) -> Column:
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = list(map(count, BASE_KINDS))
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("b")), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def redact(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``df`` with every span of :func:`find_personal_data` replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the first's kind. Rows without a
    span stay as they are; ``length_column``, if there, follows the new text.
    """
    spans = _fresh(df, "personal_spans")
    seen = with_candidates(df.select(ref(text_column).alias("text")), F.col("text"), "spans")
    model = train(stored(seen.select("spans"), "personal"))
    rows = with_candidates(df, ref(text_column), spans)
    rows = rows.withColumn(spans, accepted(F.col(spans), model, min_probability))
    text = ref(text_column)

    def step(state: Column, s: Column) -> Column:
        start = s["start"]
        # A span that begins within the last one only lengthens it.
        fresh = F.concat(
            state["text"],
            F.substring(text, (state["end"] + 1).cast("int"), (start - state["end"]).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        )
        return F.struct(
            F.greatest(state["end"], s["end"]).alias("end"), F.when(start < state["end"], state["text"]).otherwise(fresh).alias("text")
        )

    def finish(state: Column) -> Column:
        return F.concat(state["text"], F.substring(text, (state["end"] + 1).cast("int"), F.length(text)))

    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"))
    changed = F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)
    rows = rows.withColumn(text_column, changed)
    if length_column and length_column in df.columns:
        kind = df.schema[length_column].dataType
        rows = rows.withColumn(length_column, F.when(F.size(spans) > 0, F.length(ref(text_column)).cast(kind)).otherwise(ref(length_column)))
    return rows.select(*map(ref, df.columns))
