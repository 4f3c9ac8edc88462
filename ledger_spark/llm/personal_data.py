"""Personal data in texts, from labelers that vote.

Patterns give candidate spans: the base kinds and looser kinds. Labelers (format,
checksum, gazetteer, context and surroundings) vote for, against or not at all.
Expectation-maximisation on the counted vote patterns estimates how reliable
each labeler is, and a logistic classifier over votes, kind and length is
trained on the resulting probabilities. Base spans always stay; spans of the
looser kinds are added where the classifier is confident.

Texts are read once, by built-in expressions. What reaches the driver are counts
of vote patterns, whose number is bounded by the labelers and kinds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.spans import cleared, count_of, listed, matches, no_spans
from ledger_spark.staging import stage

BASE_KINDS = ["email", "ip", "card", "phone"]
LOOSE_KINDS = ["phone_local", "tax_id", "email_spelled", "person"]
KINDS = BASE_KINDS + LOOSE_KINDS
LABELERS = ["format", "check", "gazetteer", "context", "against", "edges"]
CONFIDENT = 0.5
# No labeler takes a longer span for well-formed.
LONGEST = 120
ROUNDS = 40
STEPS = 150

# The base patterns, each written so that its work is linear in the text: a
# match starts where a run starts or the last match ended, runs are possessive,
# and no group repeats without bound.
PATTERNS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
        r"[A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
    ),
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "tax_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z]{2,12}",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
# A cheap test that every text with a match passes.
PROBES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "phone_local": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "tax_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
    "email_spelled": lambda t: t.rlike(r"[\[(]at[\])]"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20"),
}
# Gazetteers and context words.
DOMAINS = "com org net edu gov info io de fr es uk eu us ca"
CARD_STARTS = "34 37 4 51 52 53 54 55 60 65"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 39 40 41 44 45 46 47 48 49 52 55 61 81 82 86 91"
GIVEN_NAMES = (
    "Anna Ben Carla David Elena Frank Grace Henry Irene James John Julia Karl Laura Maria Mark Mary "
    "Michael Nina Olga Paul Peter Rosa Sarah Thomas"
)
FOR_WORDS = "mail|contact|write|phone|call|tel|mobile|fax|card|visa|credit|address|server|host|ssn|social|name"
AGAINST_WORDS = "version|release|isbn|issn|order|invoice|page|section|figure|table|chapter|serial|part"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def part(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _accepted(kind: str):
    """The condition that a base match has to meet."""
    if kind == "ip":
        return lambda s: s["value"].rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return lambda s: luhn(_digits(s["value"]))
    if kind == "phone":
        return lambda s: F.char_length(_digits(s["value"])).between(9, 15)
    return lambda s: F.lit(True)


def candidate_spans(text: Column) -> list[Column]:
    """Candidates of each kind; base matches that fail their condition are dropped."""
    return [
        F.when(PROBES[k](text), F.filter(matches(text, PATTERNS[k], k), _accepted(k))).otherwise(no_spans()) for k in KINDS
    ]


def _one_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """Every labeler's vote on one candidate: 1 for, -1 against, 0 none."""
    kind, value = s["kind"], s["value"]
    digits = _digits(value)
    mail, number = kind.startswith("email"), kind.isin("phone", "phone_local")
    strict = (
        F.when(F.char_length(value) > LONGEST, F.lit(False))
        .when(mail, value.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2,12}$"))
        .when(kind == "ip", value.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"))
        .when(kind == "card", F.char_length(digits).isin(15, 16))
        .when(number, value.rlike(r"^(\+[1-9][0-9]{0,2}[\x20.-]?)?\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-]?[0-9]{4}$"))
        .when(kind == "tax_id", value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"))
        .otherwise(value.rlike(r"^[A-Za-z.]+ [A-Z][a-z]+ [A-Z][a-z]+$"))
    )
    check = (
        F.when(mail, F.char_length(value) <= 64)
        .when(kind == "ip", ~value.rlike(r"^(0|127|255)\."))
        .when(kind == "card", luhn(digits))
        .when(number, F.char_length(digits).between(10, 13))
        .when(kind == "tax_id", ~value.rlike(r"^([0-9])\1\1-\1\1-"))
        .otherwise(F.char_length(value) <= 40)
    )
    listed_value = (
        F.when(mail, F.right(value, F.lit(LONGEST)).rlike(rf"[.\])\x20]{_one_of(DOMAINS)}$"))
        .when(kind == "card", digits.rlike(rf"^{_one_of(CARD_STARTS)}"))
        .when(kind == "phone", digits.rlike(rf"^{_one_of(COUNTRY_CODES)}"))
        .when(kind == "person", value.rlike(rf"\x20{_one_of(GIVEN_NAMES)}\b"))
    )
    near = F.lower(s["before"])
    tight = s["before"].rlike(r"(^|[\s(\[<\"':,;])$") & s["after"].rlike(r"^($|[\s)\]>\"',;.!?])")
    return {
        "format": _vote(strict, ~strict),
        "check": _vote(check, ~check),
        "gazetteer": _vote(listed_value, ~listed_value),
        "context": _vote(near.rlike(rf"\b(?:e-?)?(?:{FOR_WORDS})"), F.lit(False)),
        "against": _vote(F.lit(False), near.rlike(rf"\b(?:{AGAINST_WORDS})\W*$") | s["before"].rlike(r"[#/=_]$")),
        "edges": _vote(tight, ~tight),
    }


@dataclass
class SpanModel:
    """Labelers' reliabilities and the weights of the final classifier."""

    reliability: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)
    weights: dict[tuple[str, object], float] = field(default_factory=dict)

    def probability(self, s: Column) -> Column:
        """The classifier on one candidate, as an expression of literals."""
        total = F.lit(self.weights.get(("bias", 0), 0.0))
        for name in ["kind", "size", *LABELERS]:
            for (feature, value), weight in self.weights.items():
                if feature == name:
                    total = total + F.when(s[name] == F.lit(value), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def estimate(patterns: list[dict]) -> SpanModel:
    """Fit reliabilities and classifier to counted vote patterns.

    A pattern has ``kind``, ``size``, a vote per labeler and ``count``. The
    first guess of a pattern's probability is the share of its votes that are
    for; then each round estimates P(vote | true) and P(vote | false) of every
    labeler, given that it votes, and the share of true spans of every kind from
    the probabilities, and the probabilities from these.
    """
    if not patterns:
        return SpanModel()
    voted = [[p[n] for n in LABELERS] for p in patterns]
    count = [float(p["count"]) for p in patterns]
    true = [(1 + sum(v == 1 for v in vs)) / (2 + sum(v != 0 for v in vs)) for vs in voted]
    rate: dict[tuple[str, int], tuple[float, float]] = {}
    for _ in range(ROUNDS):
        for i, name in enumerate(LABELERS):
            yes, no = {-1: 0.5, 1: 1.0}, {-1: 1.0, 1: 0.5}
            for vs, c, t in zip(voted, count, true):
                if vs[i]:
                    yes[vs[i]] += c * t
                    no[vs[i]] += c * (1 - t)
            a, b = yes[1] / sum(yes.values()), no[1] / sum(no.values())
            if a < b:  # a labeler is never taken for worse than chance
                a = b = (yes[1] + no[1]) / (sum(yes.values()) + sum(no.values()))
            rate[name, 1], rate[name, -1], rate[name, 0] = (a, b), (1 - a, 1 - b), (1.0, 1.0)
        share: dict[str, list[float]] = {}
        for p, c, t in zip(patterns, count, true):
            known = share.setdefault(p["kind"], [1.0, 1.0])
            known[0] += c * t
            known[1] += c * (1 - t)
        for k, (p, vs) in enumerate(zip(patterns, voted)):
            a, b = (math.log(x / sum(share[p["kind"]])) for x in share[p["kind"]])
            for name, v in zip(LABELERS, vs):
                a += math.log(rate[name, v][0])
                b += math.log(rate[name, v][1])
            true[k] = 1 / (1 + math.exp(min(max(b - a, -50), 50)))

    active = [[("bias", 0), ("kind", p["kind"]), ("size", p["size"]), *((n, v) for n, v in zip(LABELERS, vs) if v)] for p, vs in zip(patterns, voted)]
    total = sum(count)
    weights = {f: 0.0 for fs in active for f in fs}
    power = {f: 1e-9 for f in weights}
    for _ in range(STEPS):
        slope = {f: -1e-3 * w for f, w in weights.items()}
        for fs, c, t in zip(active, count, true):
            z = sum(weights[f] for f in fs)
            error = c / total * (t - 1 / (1 + math.exp(-min(max(z, -50), 50))))
            for f in fs:
                slope[f] += error
        for f, g in slope.items():
            power[f] += g * g
            weights[f] += 0.5 * g / math.sqrt(power[f])
    return SpanModel(rate, weights)


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base) of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``. Positions count code points, the end
    is exclusive. A null text is empty; ids may be null or repeat, since every
    row stands for itself; other columns are left out. Without candidates nothing
    is trained or added; an empty table gives no rows. A text of any length, with
    any number of matches, is searched whole.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.concat(*candidate_spans(text)).alias("found"))

    def judged(s: Column) -> Column:
        size = F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(3)).cast("int")
        given = [vote.alias(name) for name, vote in votes(s).items()]
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["kind"].isin(BASE_KINDS).alias("base"), size.alias("size"), *given,
        )

    rows = stage(found.select("doc_id", F.transform("found", judged).alias("found")), "candidates")
    single = rows.select(F.explode("found").alias("s")).select("s.*")
    patterns = single.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("count"))
    order = lambda p: (p["kind"], p["size"], *(p[n] for n in LABELERS))
    model = estimate(sorted((r.asDict() for r in patterns.collect()), key=order))

    base = F.filter("found", lambda s: s["base"])
    split = rows.select("doc_id", "found", base.alias("base"))

    def sure(s: Column) -> Column:
        return ~s["base"] & (model.probability(s) > CONFIDENT)

    brief = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    own = F.transform("base", brief)
    if model.weights:
        own = F.concat(own, cleared(F.transform(F.filter("found", sure), brief), own))
    return split.select("doc_id", own.alias("spans"))


def personal_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the number of base spans, their digest and all spans as text."""
    found = personal_spans(docs)
    own = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(own, BASE_KINDS), 256).alias("base_sha256"),
        listed(F.col("spans"), KINDS).alias("spans"),
    )
