"""Personal data by weak supervision, with DataFrame functions only.

Candidates come from patterns: the four base kinds, whose rule makes them certain, and looser look-alikes.
Three labelers vote on each candidate (1 for, -1 against, 0 abstains): its kind's strict rule, gazetteers,
and the words before it. Expectation-maximisation over the counts of vote patterns estimates how far each
labeler is to be trusted, and so how probable each candidate is; a naive Bayes span classifier learns
from these probabilities and decides on the look-alikes. Base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barloom.llm import spans
from barloom.llm.common import settled

BASE = ["email", "ip", "card", "phone"]
#: Look-alike kinds, each of the family of a base kind.
LOOSE = {"email_like": "email", "card_like": "card", "phone_like": "phone"}
KINDS = [*BASE, *LOOSE]
_LOCAL = "[A-Za-z0-9._%+-]"
# Java matches possessive groups in a loop, others by recursion; and no try begins inside a run that failed at its start, so
# time stays linear: a match ends only where a run of its characters does.
_PATTERNS = {
    # A longest run of digits, each but the first after one blank or hyphen at most: 16 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_like": rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{2,64}}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{2,63}}\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{{2,10}}(?![A-Za-z0-9])",
    "phone_like": r"(?<![0-9+.()-])(?<![0-9+.()-]\x20)(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9.-])",
}
#: What every match of a kind holds one of.
_MARKS = {"email": ("@",), "ip": (".",), "phone": ("+",), "email_like": ("(at)", "[at]"), "phone_like": ("-", ".")}
#: Fixed word and number lists.
_DOMAINS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|us|eu|ch|at|nl|be|pt|se|no|dk|fi|pl|cz|ca|au|jp|cn|in|br|mx|ru"
_DIAL_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)"
_FOR = "(?i)(?:e-?mail|phone|tel|call|mobile|fax|contact|card|visa|credit|payment|account|address|reach|write to|correo|t[ée]l[ée]fono|llame|tarjeta|courriel|t[ée]l[ée]phone|appel|carte|telefon|anruf|karte)[^\\n]{0,12}$"
_AGAINST = "(?i)(?:version|isbn|issn|page|order|invoice|serial|article|section|no\\.|number of|doi|release)[^\\n]{0,6}$"


def _luhn(digits: Column) -> Column:
    """Whether digits (a string) pass the Luhn checksum."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(span: Column) -> Column:
    return F.regexp_replace(span["found"], "[^0-9]", "")


def _small_parts(span: Column) -> Column:
    """Whether all four numbers are at most 255."""
    return F.forall(F.split(span["found"], r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))


def candidates(text: Column, context: int = 40) -> Column:
    """Base spans and look-alikes of a text, in no order."""
    find = lambda kind: spans.matches(text, kind, _PATTERNS[kind], context, _MARKS.get(kind, ()))
    card = find("card")
    parts = [
        find("email"),
        F.filter(find("ip"), _small_parts),
        F.transform(card, lambda s: F.struct(F.when(_luhn(_digits(s)), F.lit("card")).otherwise(F.lit("card_like")).alias("kind"), *[s[k].alias(k) for k in ("start", "end", "found", "before")])),
        F.filter(find("phone"), lambda s: F.length(_digits(s)).between(8, 15)),
        find("email_like"),
        find("phone_like"),
    ]
    return reduce(F.concat, parts)


def _family(span: Column) -> Column:
    return F.regexp_replace(span["kind"], "_like$", "")


def _votes(span: Column) -> list[Column]:
    """Of the rule, the gazetteers and the context: 1, 0 or -1."""
    digits, family = _digits(span), _family(span)
    rule = F.when(span["kind"].isin(*BASE), 1).when(span["kind"] == "card_like", -1).otherwise(0)
    known = (
        F.when(family == "email", F.when(F.lower(span["found"]).rlike(f"(?:{_DOMAINS})$"), 1).otherwise(-1))
        .when(family == "card", F.when(digits.rlike(f"^(?:{_ISSUERS})"), 1).otherwise(-1))
        .when(family == "phone", F.when(span["kind"] == "phone_like", F.when(digits.rlike("^[2-9]1?[02-9][0-9]*$"), 1).otherwise(-1)).when(digits.rlike(f"^(?:{_DIAL_CODES})"), 1).otherwise(-1))
        .otherwise(F.when(span["found"].rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
    )
    around = F.when(span["before"].rlike(_FOR), 1).when(span["before"].rlike(_AGAINST), -1).otherwise(0)
    return [rule, known, around]


def _features(span: Column) -> list[Column]:
    """What the span classifier sees, as a few values each: at most 40 lengths and 11 * 11 pairs of marks a family."""
    return [
        span["kind"],
        F.concat(_family(span), F.lit(":"), F.least(F.length(span["found"]), F.lit(40)).cast("string")),
        F.regexp_extract(span["before"], "([A-Za-z]|[0-9]|[^A-Za-z0-9])$", 1).rlike("[A-Za-z0-9]").cast("string"),
        F.concat(_family(span), F.lit(":"), F.regexp_replace(span["found"], "[A-Za-z0-9]+", "").substr(1, 2)),
        F.concat(_family(span), F.lit(":"), _votes(span)[1].cast("string")),
        _votes(span)[2].cast("string"),
    ]


class Model(NamedTuple):
    prior: float  # log odds
    weights: list[dict[str, float]]  # log odds of each value of each feature
    trust: dict[str, list[float]]  # how often each labeler is right, by family


def reliabilities(rows: list[Row], rounds: int = 50) -> tuple[dict[tuple, float], dict[str, list[float]]]:
    """Expectation-maximisation over counts of (family, votes): the probability of each pattern, and
    how often each labeler is right where it votes. rows: family, v0, v1, v2, n; at most 27 for each family."""
    posterior: dict[tuple, float] = {}
    trust: dict[str, list[float]] = {}
    for family in sorted({r["family"] for r in rows}):
        own = [((r["v0"], r["v1"], r["v2"]), r["n"]) for r in rows if r["family"] == family]
        share, right = 0.5, [0.95, 0.8, 0.7]
        for _ in range(rounds):
            p = {}
            for votes, _n in own:
                odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right, strict=True))
                p[votes] = 1 / (1 + math.exp(-odds))
            total = sum(n for _, n in own)
            share = min(0.99, max(0.01, (sum(n * p[v] for v, n in own) + 1) / (total + 2)))
            for k, first in enumerate((0.95, 0.8, 0.7)):  # a prior worth ten votes keeps rare families sane
                good = 10 * first + sum(n * (p[v] if v[k] > 0 else 1 - p[v]) for v, n in own if v[k])
                right[k] = min(0.995, max(0.505, good / (10 + sum(n for v, n in own if v[k]))))
        posterior |= {(family, *v): x for v, x in p.items()}
        trust[family] = right
    return posterior, trust


def train(found: DataFrame) -> Model:
    """Learns from all candidates of found (spans). The driver gets counts of vote patterns and of feature
    values, whose numbers the rules above bound, not candidates."""
    one = found.select(F.explode("spans").alias("s"))
    s = F.col("s")
    family, votes = _family(s), _votes(s)
    labelled = one.select(family.alias("family"), *[v.alias(f"v{k}") for k, v in enumerate(votes)], *[F.coalesce(f, F.lit("")).alias(f"f{k}") for k, f in enumerate(_features(s))])
    rows = labelled.groupBy("family", "v0", "v1", "v2").agg(F.count("*").alias("n")).collect()
    posterior, trust = reliabilities(rows)
    if not posterior:
        return Model(0.0, [{} for _ in range(6)], {})
    table = F.create_map(*[F.lit(x) for (fam, *v), p in sorted(posterior.items()) for x in (":".join(map(str, (fam, *v))), p)])
    weighed = labelled.withColumn("p", table[F.concat_ws(":", "family", *[F.col(f"v{k}").cast("string") for k in range(3)])])
    pairs = weighed.select("p", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("value")) for k in range(6)])).alias("f"))
    sums = pairs.groupBy("f.k", "f.value").agg(F.sum("p").alias("good"), F.sum(1 - F.col("p")).alias("bad")).collect()
    good, bad = (sum(r[c] for r in sums if r["k"] == 0) for c in ("good", "bad"))
    weights: list[dict[str, float]] = [{} for _ in range(6)]
    for r in sums:
        weights[r["k"]][r["value"]] = math.log((r["good"] + 0.5) / (good + 1)) - math.log((r["bad"] + 0.5) / (bad + 1))
    return Model(math.log((good + 0.5) / (bad + 0.5)), weights, trust)


def _score(model: Model, span: Column) -> Column:
    """Log odds that the span is personal data."""
    out = F.lit(model.prior)
    for weights, value in zip(model.weights, _features(span), strict=True):
        if weights:
            out = out + F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])[F.coalesce(value, F.lit(""))], F.lit(0.0))
    return out


def find(docs: DataFrame, threshold: float = 0.95, into: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with the column `into`: base spans and the look-alikes that the
    classifier takes for personal data with a probability of threshold or more, by kind as in KINDS, then start.

    Texts are searched once; candidates are then written beside the kept columns to the shared folder, so that
    learning and deciding read them there. Null and empty texts: no spans. Repeated rows each have their
    own. A column of docs named as `into` is replaced. No rows: none.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != into]
    found = settled(docs.select(*kept, candidates(F.coalesce(F.col("text"), F.lit(""))).alias(into)), "pii-candidates")
    model, least = train(found.select(F.col(into).alias("spans"))), math.log(threshold / (1 - threshold))
    chosen = F.filter(into, lambda s: s["kind"].isin(*BASE) | (_score(model, s) >= least))
    return found.withColumn(into, spans.ordered(chosen, KINDS, by_kind=True))


def redact(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """docs with each span of text replaced by its kind, as <EMAIL>; same rows and columns."""
    own = "spans_of_text"
    while own in docs.columns:
        own += "_"
    by_start = spans.ordered(F.col(own), KINDS, by_kind=False)
    return find(docs, threshold, own).withColumn("text", spans.replaced(F.col("text"), by_start)).select(*[F.col(f"`{c}`") for c in docs.columns])
