"""Secrets in texts, found through an inverted index of trigrams.

Each rule's pattern is read into a Boolean query: every match holds, for each
clause, one of the clause's strings, and a string holds all its trigrams. The
index has one posting per document and trigram that some rule asks for.
Intersecting the postings gives each rule's candidate documents, and only these
are matched against its pattern. A rule without a usable clause scans all
documents. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.ngram_join import BROADCAST_IDS
from ledger_spark.llm.spans import count_of, listed, masked, matches, no_spans
from ledger_spark.staging import stage

# Strings that one clause of a query may list.
MAX_STRINGS = 24
MASK = "[SECRET]"
# Trigrams asked for each string.
KEPT = 2
# Fixed value: letters from common to rare in running text; other characters are rarer.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and a least length of the match or of one group."""

    kind: str
    pattern: str
    length: int = 0
    group: int = 0


# The three base rules. Where a run is the whole match its least length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published formats of service tokens and keys.
MORE_RULES = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login_url", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


def clauses(pattern: str) -> list[set[str]]:
    """Lower-cased strings of which every match holds one, for each clause.

    Strings grow along the pattern as long as there are few; at a repetition or a
    wide character class they end and become a clause. Clauses with a string
    under three characters say nothing and are left out.
    """
    parser = re._parser
    found: list[set[str]] = []

    def flush(now: set[str]) -> set[str]:
        if min(map(len, now)) >= 3:
            found.append(now)
        return {""}

    def exact(node) -> set[str] | None:
        """All strings of a node, or None if they are many."""
        kind, value = node
        name = str(kind)
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN":
            out: set[str] = set()
            for k, v in value:
                if str(k) == "LITERAL":
                    out.add(chr(v).lower())
                elif str(k) == "RANGE" and v[1] - v[0] < 4:
                    out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return out
        if name == "SUBPATTERN":
            return whole(value[-1])
        if name == "BRANCH":
            parts = [whole(b) for b in value[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if name in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and value[1] == 1:
            part = whole(value[2])
            return None if part is None else part | ({""} if value[0] == 0 else set())
        return {""} if name in ("AT", "ASSERT", "ASSERT_NOT") else None

    def whole(nodes) -> set[str] | None:
        now = {""}
        for node in nodes:
            part = exact(node)
            if part is None or len(now) * len(part) > MAX_STRINGS:
                return None
            now = {a + b for a, b in product(now, part)}
        return now

    now = {""}
    for node in parser.parse(pattern):
        part = exact(node)
        if part is None or len(now) * len(part) > MAX_STRINGS:
            now = flush(now)
            if part is not None and len(part) <= MAX_STRINGS:
                now = part
        else:
            now = {a + b for a, b in product(now, part)}
    flush(now)
    return found


def trigrams(string: str) -> set[str]:
    return {string[i : i + 3] for i in range(len(string) - 2)}


def asked_trigrams(strings: set[str]) -> list[list[str]]:
    """The trigrams that stand for each string of a clause: its ``KEPT`` rarest ones.

    A string that holds another one of the clause says nothing more than that one
    and is left out. Rarity goes by how common the letters are.
    """
    shortest = [s for s in strings if not any(t != s and t in s for t in strings)]
    common = lambda gram: (sum(len(LETTERS) - LETTERS.index(c) for c in gram if c in LETTERS), gram)
    return [sorted(trigrams(s), key=common)[:KEPT] for s in sorted(shortest)]


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """One row per document and wanted trigram that its lower-cased text holds."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``doc_id`` and the rules whose trigram query it satisfies; None without queries.

    The query table has a row per rule, clause, string and trigram; its size
    depends on the rules only, so it is broadcast.
    """
    asked, sizes = [], []
    for rule in rules:
        parts = clauses(rule.pattern)
        for c, strings in enumerate(parts):
            for s, grams in enumerate(asked_trigrams(strings)):
                asked += [(rule.kind, c, s, len(grams), len(parts), g) for g in grams]
    if not asked:
        return None
    names = ("rule", "clause", "string", "n_grams", "n_clauses", "trigram")
    lines = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in asked]
    query = docs.sparkSession.range(1).select(F.inline(F.array(*lines)))
    index = stage(postings(docs, sorted({a[-1] for a in asked})), "postings")
    both = index.join(F.broadcast(query), "trigram")
    strings = both.groupBy("doc_id", "rule", "n_clauses", "clause", "string", "n_grams").agg(
        F.count_distinct("trigram").alias("n")
    )
    held = strings.filter("n = n_grams").groupBy("doc_id", "rule", "n_clauses").agg(F.count_distinct("clause").alias("n"))
    return held.filter("n = n_clauses").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    found = matches(text, rule.pattern, rule.kind)
    if rule.group:
        return F.filter(
            found, lambda s: F.char_length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.length
        )
    return F.filter(found, lambda s: F.char_length(s["value"]) >= rule.length)


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """``docs`` and its spans under ``name``, which it does not have."""
    full = [r for r in rules if not clauses(r.pattern)]
    asked = [r for r in rules if clauses(r.pattern)]
    found = candidates(docs, rules)
    text = F.coalesce("text", F.lit(""))
    spans = []
    for rule in full:
        spans.append(F.when(text.rlike(rule.pattern), _spans(text, rule)).otherwise(no_spans()))
    if found is not None:
        found = stage(found.select(F.col("doc_id").alias("__id"), F.col("rules").alias("__rules")), "candidates")
        few = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        docs = docs.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        for rule in asked:
            chosen = F.array_contains("__rules", rule.kind)
            spans.append(F.when(chosen, _spans(text, rule)).otherwise(no_spans()))
    return docs.withColumn(name, F.concat(*spans)).drop("__id", "__rules")


def with_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``secret_spans`` (kind, start, end, value).

    ``docs`` needs ``doc_id`` and ``text``. Positions count code points, the end
    is exclusive. A null text has no spans; a null or repeated doc_id only makes
    more candidates; an empty table gives no rows; a text of any length, with any
    number of matches, is searched whole. An existing column ``secret_spans`` is
    replaced.
    """
    return _with_spans(docs.drop("secret_spans"), rules, "secret_spans")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the number of base matches, their digest and all spans as text."""
    kinds = [r.kind for r in RULES]
    base = [r.kind for r in BASE_RULES]
    found = with_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    own = F.filter("secret_spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count_of(F.col("secret_spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(listed(own, base), 256).alias("base_sha256"),
        listed(F.col("secret_spans"), kinds).alias("spans"),
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask.

    Overlapping spans share one mask. A column ``n_chars``, if there is one,
    follows the new text. Null texts stay null. All other columns stay as they
    are, whatever their names; the spans themselves are not returned.
    """
    found = _with_spans(docs, RULES, "__secret_spans")
    touched = F.size("__secret_spans") > 0
    found = found.withColumn("__masked", F.when(touched, masked(F.col("text"), F.col("__secret_spans"), MASK)).otherwise(F.col("text")))
    changed = {"text": F.col("__masked")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(touched, F.char_length("__masked").cast(kind)).otherwise(F.col("n_chars"))
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
