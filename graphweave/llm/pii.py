"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns propose spans. Regex, gazetteer and context labelers vote on each or abstain,
expectation-maximisation over all vote patterns estimates their reliabilities, and a logistic span
classifier is trained on the resulting probabilities. Besides the votes it sees what no labeler
looks at: the word before the span, hashed, and marks of its form. Base spans always stand; the
classifier decides on the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm import spans, weak
from graphweave.llm.common import store

# The base patterns, written so that no search goes back: possessive runs, and starts
# only where a run starts or the match before ended. A card is a whole chain of digits with single
# separators, whose length stands in the pattern, so that tables of numbers give no matches to drop.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Proposals beyond the base.
LOCAL_PHONE = r"(?<![0-9+(.-])(?<![0-9+][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_TITLE = r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Dear|Name)[.:]?\x20)"
_SURNAME = r"\x20[A-Z][a-z]++(?![A-Za-z])"
#: Buckets of the word before a span; 0 is no word.
WORDS = 32
KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "name")
#: Gazetteers, short on purpose; a caller can pass longer ones.
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Maria Jose Juan Pierre Marie Jean Hans Klaus".split()
#: What stands right before a span of a kind, and what stands before things that only look alike.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|mail(?:to)?|write to)\W{0,4}$", "ip": r"(?i)(?:\bip|address|host|server|from)\W{0,4}$", "card": r"(?i)(?:card|visa|mastercard|amex|payment)\W{0,12}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|cell|fax|contact)\W{0,6}$", "local_phone": r"(?i)(?:phone|call|tel|mobile|cell|fax|contact)\W{0,6}$",
    "national_id": r"(?i)(?:ssn|social security|national id|tax id)\W{0,8}(?:number|no)?\W{0,4}$", "name": r"(?i)(?:\bmr|\bmrs|\bms|\bdr|prof|name(?: is)?|dear|signed|regards)\W{1,4}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|part|serial|build|release|chapter|figure|table)\W{0,6}(?:no|number)?\W{0,4}$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether 16 to 19 digits in hit pass the Luhn check."""
    digits = F.reverse(_digits(hit))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": luhn,
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0).cast("byte")


def _span(kind: str, x: Column, names: list[str]) -> Column:
    """A proposed span with its votes and the classifier's features."""
    no = F.lit(False)
    shape = {
        "email": _vote(F.lit(True), no), "ip": _vote(F.lit(True), no), "card": _vote(F.lit(True), no), "phone": _vote(F.lit(True), no),
        "local_phone": _vote(x["hit"].rlike(r"^\("), ~x["hit"].rlike(r"^\(?[2-9]")), "national_id": _vote(~x["hit"].rlike("^(?:000|666|9)|-00-|-0000$"), x["hit"].rlike("^(?:000|666|9)|-00-|-0000$")), "name": F.lit(0).cast("byte"),
    }[kind]
    known = {
        "email": _vote(x["hit"].rlike(r"(?i)\.(?:com|org|net|edu|io|de|fr|es|uk)$"), no), "ip": _vote(no, x["hit"].rlike(r"^(?:127\.|0\.|255\.)")),
        "card": _vote(x["hit"].rlike("^[3-6]"), no), "phone": _vote(x["hit"].rlike(r"^\+(?:1|33|34|44|49)(?![0-9]{13})"), no),
        "local_phone": F.lit(0).cast("byte"), "national_id": F.lit(0).cast("byte"), "name": _vote(F.substring_index(x["hit"], " ", 1).isin(names), ~F.substring_index(x["hit"], " ", 1).isin(names)),
    }[kind]
    near = _vote(x["before"].rlike(CONTEXT[kind]), x["before"].rlike(AGAINST))
    word = F.lower(F.regexp_extract(x["before"], r"(\pL+)[^\pL]*$", 1))
    own = {"word": F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS - 1)) + 1).cast("int"), "colon": x["before"].rlike(r"[:=]\s*$"), "digit": x["before"].rlike(r"[0-9]\s*$"), "same": x["hit"].rlike(r"([0-9])\1\1")}
    return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).cast("long").alias("rank"), x["start"].alias("start"), x["end"].alias("end"), shape.alias("shape"), known.alias("known"), near.alias("near"), *(v.cast("int").alias(k) for k, v in own.items()))


def _found(text: str, names: list[str]) -> Column:
    def of(kind: str, pattern: str) -> Column:
        hits = spans.matches(text, pattern, context=32)
        if kind in VALID:
            hits = F.filter(hits, lambda x: VALID[kind](x["hit"]))
        return F.transform(hits, lambda x: _span(kind, x, names))

    # a name is proposed after a title, or where the gazetteer knows the first name
    name = rf"(?<![A-Za-z])(?:{_TITLE}[A-Z][a-z]++|{'|'.join(names)}){_SURNAME}"
    return F.concat(*(of(*x) for x in zip(KINDS, (EMAIL, IP, CARD, PHONE, LOCAL_PHONE, NATIONAL_ID, name))))


VOTED, FEATURES = ("shape", "known", "near"), ("colon", "digit", "same")


def train(rows: list[tuple[dict, int, float]], rounds: int = 120, rate: float = 1.0) -> dict[str, float]:
    """Logistic regression on (span, rows, probability) by gradient steps: the kind, the votes, the word before and the marks."""
    w: dict[str, float] = {"bias": 0.0}
    total = sum(n for _, n, _ in rows) or 1
    named = []
    for f, n, p in rows:
        xs = [("bias", 1.0), (f"kind={f['kind']}", 1.0), (f"word={f['word']}", 1.0), *((k, float(f[k])) for k in (*VOTED, *FEATURES) if f[k])]
        named.append((xs, n / total, p))
    for _ in range(rounds):
        step: dict[str, float] = {}
        for xs, share, p in named:
            error = share * (p - 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in xs))))
            for k, v in xs:
                step[k] = step.get(k, 0.0) + error * v
        for k, v in step.items():
            w[k] = w.get(k, 0.0) + rate * v - 1e-4 * w.get(k, 0.0)
    return w


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, names: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns `keep` and a struct gw: base (array of kind, rank, start, end) and all_spans, with the classifier's.

    Base spans are the e-mail addresses, IP addresses, cards and phone numbers that pass their
    checks. Local phone numbers, national ids and names are added where the classifier gives them
    `threshold` or more. names is the gazetteer of first names. Both arrays are sorted by kind as listed, then start. A null text counts as
    empty; repeated rows are returned each; an empty table gives an empty table. Columns of docs may
    have any names that don't begin with gw. The fit counts vote patterns over all rows.
    """
    names = names or FIRST_NAMES
    df = docs.select(*(F.col(f"`{c}`") for c in keep or []), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("gw_text"))
    seen = store(df.select(*(F.col(f"`{c}`") for c in keep or []), _found("gw_text", names).alias("gw_found")), "pii")
    # at most kinds x 27 patterns of votes x words x 8 rows, whatever the size of the corpus
    seen_patterns = seen.select(F.explode("gw_found").alias("x")).groupBy("x.kind", *(f"x.{c}" for c in (*VOTED, "word", *FEATURES))).count().collect()
    seen_patterns = sorted((r.asDict() for r in seen_patterns), key=lambda r: tuple(r.values()))
    voted: dict[tuple[int, ...], int] = {}
    for r in seen_patterns:
        votes = tuple(r[c] for c in VOTED)
        voted[votes] = voted.get(votes, 0) + r["count"]
    model = weak.fit(list(voted.items()), len(VOTED), prior=0.7, prior_range=(0.3, 0.9))
    weights = train([(r, r["count"], model.posterior([r[c] for c in VOTED])) for r in seen_patterns])

    def likely(x: Column) -> Column:
        odds = F.lit(weights["bias"])
        for kind in KINDS:
            odds = odds + F.when(x["kind"] == kind, weights.get(f"kind={kind}", 0.0)).otherwise(0.0)
        odds = odds + F.get(F.array(*(F.lit(weights.get(f"word={k}", 0.0)) for k in range(WORDS))), x["word"])
        for name in (*VOTED, *FEATURES):
            odds = odds + x[name] * F.lit(weights.get(name, 0.0))
        return 1 / (1 + F.exp(-odds)) >= threshold

    base = F.filter("gw_found", lambda x: x["rank"] < len(VALID))
    added = F.filter("gw_found", lambda x: (x["rank"] >= len(VALID)) & likely(x))
    return seen.select(*(F.col(f"`{c}`") for c in keep or []), F.struct(spans.by_rank(base).alias("base"), spans.by_rank(F.concat(base, added)).alias("all_spans")).alias("gw"))
