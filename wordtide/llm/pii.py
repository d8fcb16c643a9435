"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are spans that one of the patterns finds. Four are the base kinds (email,
ip, card, phone); valid base spans are always kept. Wider patterns propose more:
spelled-out addresses, national phone numbers, card-like numbers that fail their
check digit, account numbers (by the length of their country) and secrets. Six labelers vote on every candidate, for
(1), against (-1) or not (0):

``strict``  a narrower pattern of the kind        ``valid``  check digits, octets, lengths, variety of signs
``cue``     words before it that announce it      ``rival``  words that announce other numbers
``shape``   what stands next to it                ``listed`` lists of issued and reserved values

Votes are counted by kind and pattern of votes over all documents (at most kinds *
3**6 rows). Expectation-maximisation estimates, for every kind, how often each
labeler votes so on true and on false spans; kinds with few candidates lean on the
rates of all kinds together. The posteriors are the soft labels of a logistic
classifier of spans, whose features are the span's own: kind, length, share
of digits, letter cases, breaks, neighbours, nearest cue and check; it is fitted on counts by
pattern of features (at most ``MOST_FEATURES`` rows). These counts are all that
comes to the driver. A span that the classifier takes and that overlaps no base span
is added; of added spans that overlap each other the leftmost stays.

Only column functions touch texts: positions come from splitting a text by a
pattern, and are in code points, end exclusive. Running sums go in blocks, and
context is read from the pieces between matches, so that a long text with very many
matches stays near linear. The patterns start at run borders and use possessive
repeats, so that long runs of one character class stay linear; no repeat has an upper
bound but those that the format itself has.

Defined cases: null is the empty text; a text without candidates has the digest of
the empty string; repeated rows are treated alike; an empty table gives an empty
result; with no candidate the classifier keeps only base spans; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of, written

#: Patterns of the base kinds, as the contract lists them, started at run borders.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Length of an account number of each country (IBAN).
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
_IBAN = "|".join(
    rf"(?:{'|'.join(c for c, n in IBAN_LENGTH.items() if n == length)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length in sorted(set(IBAN_LENGTH.values()))
)
_NAMED = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|secret|private)[_-]?key)"
_ISSUED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+"
#: Patterns that propose more spans.
WIDER = {
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{2,}+)+",
    "phone_national": r"(?<![0-9+])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/.-][0-9]{2,8}(?:[\x20.-][0-9]{2,4}){0,4})(?![0-9-])",
    "account": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![A-Za-z0-9-])",
    "secret": rf"(?<![A-Za-z])(?:{_NAMED}[\x22']?\x20*+[=:]\x20*+(?:\x22[^\x22\n]{{8,}}+\x22|'[^'\n]{{8,}}+'|(?:(?i:bearer)\x20+)?[A-Za-z0-9_./+=~-]{{8,}}+)|(?i:bearer)\x20+[A-Za-z0-9_./+=~-]{{16,}}+|(?:{_ISSUED})(?![A-Za-z0-9]))",
}
#: A cheap test that a text can hold a match at all.
NEEDS = {
    "email": "@",
    "phone": "+",
    "ip": ".",
    "email_spelled": "at",
}
#: Patterns that every text with a match of the kind holds as well: a first look that loses nothing.
IMPLIED = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11}",
    "account": r"[A-Z]{2}[0-9]{2}\x20?+[A-Z0-9]|[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone_national": r"[0-9]{3}[-.\x20][0-9]{4}|0[0-9]{1,4}\)?+[\x20/.-][0-9]{2}",
    "secret": r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|key)[\x22']?\x20*+[=:]|(?i:bearer)\x20|AKIA|gh[pousr]_|eyJ",
}
#: Matches of the card pattern that fail their check digit: no base span, but the classifier judges them.
CARD_LIKE = "card_like"
KINDS = [*BASE, *WIDER, CARD_LIKE]
LABELERS = ("strict", "valid", "cue", "rival", "shape", "listed")
_PATTERNS = BASE | WIDER

_GROUPED = r"^[0-9]{12,19}$|^[0-9]{4}([\x20-])(?:[0-9]{4}\1){2}[0-9]{4}$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$"
#: The narrower pattern of each kind.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": _GROUPED,
    "phone": r"^\+[1-9][0-9]*+(?:[\x20.-]?+\(?+[0-9]++\)?+)*+$",
    "email_spelled": r"(?:dot|DOT)\x20?[\])]\x20?[A-Za-z]{2,6}$",
    "phone_national": r"^\(?[2-9][0-9]{2}[).\x20-]+[2-9]|^\(?0[1-9]",
    "account": r"^[0-9]|^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]*|(?:\x20[A-Z0-9]{4})*\x20[A-Z0-9]{1,4})$",
    "secret": rf"(?:{_ISSUED})|(?=[^=:]*[=:\x20][^0-9]*[0-9])(?=[^=:]*[=:\x20].*[A-Za-z])[=:\x20][\x22']?[^\x22'\x20]{{12,}}[\x22']?$",
}
#: Words that announce personal data of a kind, and words that announce numbers of other sorts.
CUES = {
    "email": "address contact email mail reach write",
    "ip": "address client host ip server",
    "card": "card charge credit debit pay visa",
    "phone": "call contact fax mobile number phone reach tel telephone",
    "email_spelled": "address contact email mail reach write",
    "phone_national": "call contact fax mobile number phone reach tel telephone",
    "account": "account bank iban ssn security social transfer",
    "secret": "config credentials env export key let set var",
}
RIVALS = "chapter figure invoice isbn item line order page part release section total version"
#: Values that are listed: endings of domains, issuers, country codes; and values that are nobody's.
LISTED = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|dev|co|uk|de|fr|es|it|nl|eu|ch|at|us|ca)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "email_spelled": r"(?i)[\x20)\]](?:com|org|net|edu|gov|info|io|dev|co|uk|de|fr|es|it|nl|eu|ch|at|us|ca)$",
    "account": rf"^(?:{'|'.join(IBAN_LENGTH)})",
}
UNLISTED = {
    "email": r"(?i)@example\.",
    "ip": r"^(?:0+|10|127|255)\.|^192\.168\.",
    "card": r"^[01789]",
    "phone_national": r"555[-.]01",
    "account": r"^(?:000|666|9[0-9]{2})-|-00-|-0000$",
    "secret": r"(?i)[=:\x20\x22'](?:change|example|password|placeholder|x{4}|your|<)",
}
CONTEXT = 24
#: Features of a span with the number of their values.
FEATURES = {"length": 6, "digits": 4, "cases": 3, "breaks": 2, "left": 3, "right": 3, "near": 3, "checked": 3}
MOST_FEATURES = len(KINDS) * math.prod(FEATURES.values())
#: Chance of each vote on true and on false spans, as far as a kind's own candidates do not tell.
BELIEF = {-1: (0.15, 0.45), 0: (0.4, 0.4), 1: (0.45, 0.15)}
#: A check is hard to pass by chance, so its votes also weigh more where the iteration begins.
CHECKED = {-1: (0.03, 0.7), 0: (0.3, 0.25), 1: (0.67, 0.05)}


# ---- positions


def _running(values: Column, op: Callable[[Column, Column], Column], zero: Column, block: int = 128) -> Column:
    """For each place of an array of ints, ``op`` (associative) over the values before it.

    A list that grows is copied at each step, so the array is cut into blocks: within a
    block, and over the blocks' totals, lists stay short.
    """
    none = F.array().cast("array<int>")

    def listed(items: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, begin, step, lambda acc: acc["out"])

    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int"))
    parts = F.transform(numbers, lambda b: F.slice(values, b * block + 1, F.lit(block)))
    totals = F.transform(parts, lambda p: F.aggregate(p, zero, op))
    return F.flatten(F.zip_with(parts, listed(totals, zero), listed))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _matches(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds, for each kind, the matches (``f_kind``), the pieces between them (``p_``) and the matches' starts (``s_``)."""
    none = F.array().cast("array<string>")
    found, pieces, starts = {}, {}, {}
    for k in kinds:
        may = F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)
        if k in IMPLIED:
            may = may & F.col("text").rlike(IMPLIED[k])
        found[f"f_{k}"] = F.when(may, F.regexp_extract_all("text", F.lit(_PATTERNS[k]), F.lit(0))).otherwise(none)
        some = F.size(f"f_{k}") > 0
        pieces[f"p_{k}"] = F.when(some, F.split("text", _PATTERNS[k], -1)).otherwise(none)
        # a piece and the match before it: the sum up to and with it is where its match starts
        width = F.zip_with(f"p_{k}", f"f_{k}", lambda p, f: F.length(p) + F.coalesce(F.length(f), F.lit(0)))
        own = F.zip_with(_running(width, _add, F.lit(0)), f"p_{k}", lambda at, p: at + F.length(p))
        starts[f"s_{k}"] = F.when(some, own).otherwise(F.array().cast("array<int>"))
    return rows.withColumns(found).withColumns(pieces).withColumns(starts)


# ---- labelers and features


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match passes the check of its kind; null where the kind has none."""
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "phone_national":  # a length tells against a number, hardly for it
        return F.when(~F.length(_digits(value)).between(9, 12), False)
    if kind == "account":
        return F.when(value.rlike("^[A-Z]"), _mod_97(F.replace(value, F.lit(" "), F.lit(""))) == 1)
    if kind == "secret":  # of many different characters, as what is drawn at random is
        said = F.regexp_extract(value, r"(?:[=:]|(?i:bearer)\x20)\x20*[\x22']?(.*)$", 1)
        said = F.when(said == "", value).otherwise(said)
        return (F.size(F.array_distinct(F.split(said, ""))) >= 9) & said.rlike("[0-9]") & said.rlike("[A-Za-z]")
    return F.lit(None).cast("boolean")


def _mod_97(account: Column) -> Column:
    """The number that an account number stands for, its first four signs last and letters as 10 to 35, modulo 97."""
    signs = F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4))), "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).when(c != "", acc * 100 + F.ascii(c) - 55).otherwise(acc) % 97

    return F.aggregate(signs, F.lit(0), step)


def _class(c: Column) -> Column:
    """0: nothing or a blank, 1: a letter or digit, 2: another sign."""
    return F.when(c.rlike(r"[\p{L}0-9]"), 1).when(c.rlike(r"\S"), 2).otherwise(0)


def _said(words: str, before: Column) -> Column:
    return before.rlike(rf"(?:^|[^a-z])(?:{'|'.join(words.split())})[^a-z]")


def _judged(kind: str, value: Column, start: Column, before: Column, after: Column) -> Column:
    """struct<start, rank, kind, end, base, votes, features> of one match and what stands around it."""
    base = kind in BASE
    valid = _valid(kind, value)
    ok = F.coalesce(valid, F.lit(True))
    named = lambda f: F.when(ok, F.lit(f(kind))).otherwise(F.lit(f(CARD_LIKE))) if kind == "card" else F.lit(f(kind))
    low = F.lower(before)
    left, right = F.right(before, F.lit(1)), F.substring(after, 1, 1)
    cue, rival = _said(CUES[kind], low), _said(RIVALS, low)
    issued = _digits(value) if kind == "card" else value
    votes = {
        "strict": F.when(value.rlike(STRICT[kind]), 1).otherwise(-1),
        "valid": F.when(valid.isNull(), 0).when(valid, 1).otherwise(-1),
        "cue": F.when(cue, 1).otherwise(0),
        "rival": F.when(rival, -1).otherwise(0),
        "shape": F.when(left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]"), -1).otherwise(1),
        "listed": F.when(issued.rlike(UNLISTED[kind]) if kind in UNLISTED else F.lit(False), -1)
        .when(issued.rlike(LISTED[kind]) if kind in LISTED else F.lit(False), 1)
        .otherwise(0),
    }
    upper, lower = value.rlike("[A-Z]"), value.rlike("[a-z]")
    features = {
        "length": F.least(F.floor(F.log2(F.length(value).cast("double"))), F.lit(7)).cast("int") - 2,
        "digits": F.floor(F.length(_digits(value)) * 3 / F.length(value)).cast("int"),
        "cases": upper.cast("int") + lower.cast("int"),
        "breaks": value.rlike(r"[\x20-]").cast("int"),
        "left": _class(left),
        "right": _class(right),
        "near": F.when(_said(CUES[kind], F.right(low, F.lit(10))), 2).when(cue, 1).otherwise(0),
        "checked": F.when(valid.isNull(), 0).when(valid, 2).otherwise(1),
    }
    return F.struct(
        start.alias("start"),
        named(KINDS.index).alias("rank"),
        named(str).alias("kind"),
        (start + F.length(value)).alias("end"),
        (ok if base else F.lit(False)).alias("base"),
        *[v.cast("int").alias(k) for k, v in votes.items()],
        *[F.least(F.greatest(v, F.lit(0)), F.lit(FEATURES[k] - 1)).cast("int").alias(k) for k, v in features.items()],
    )


def _candidates(kind: str) -> Column:
    found, pieces, starts = f"f_{kind}", f"p_{kind}", f"s_{kind}"
    text = lambda column, i: F.coalesce(F.get(column, i), F.lit(""))

    def judged(value: Column, i: Column) -> Column:
        # what stands around a match: the pieces beside it, and the matches beyond where these are short
        before = F.right(F.concat(F.right(text(found, i - 1), F.lit(CONTEXT)), text(pieces, i)), F.lit(CONTEXT))
        after = F.concat(F.left(text(pieces, i + 1), F.lit(1)), F.left(text(found, i + 1), F.lit(1)))
        return _judged(kind, value, F.get(starts, i), before, after)

    return F.transform(found, judged)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: all candidates of the whole text with their votes and features."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = _matches(rows, list(_PATTERNS))
    return rows.select("doc_id", F.concat(*[_candidates(k) for k in _PATTERNS]).alias("found"))


# ---- reliabilities and the classifier

Pattern = tuple[str, tuple[int, ...]]


@dataclass
class Labeling:
    """Reliabilities by kind and labeler (chance of each vote on true and on false spans), posteriors of the patterns of votes, and classifier weights."""

    prior: dict[str, float] = field(default_factory=dict)
    vote: dict[str, dict[str, dict[int, tuple[float, float]]]] = field(default_factory=dict)
    posterior: dict[Pattern, float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)


def aggregate_votes(patterns: list[tuple[Pattern, int]], rounds: int = 60, lean: float = 20.0) -> Labeling:
    """EM over counted patterns of votes ((kind, votes), count): one set of reliabilities a kind.

    Votes are taken as independent given the truth. ``lean`` counts as so many true and as
    many false candidates on which labelers vote by ``BELIEF``, the check by ``CHECKED``.
    """
    check = LABELERS.index("valid")
    m = Labeling(posterior={p: 1 / (1 + math.exp(-1.5 * (sum(p[1]) + 3 * p[1][check]))) for p, _ in patterns})
    by_kind: dict[str, list[tuple[tuple[int, ...], int]]] = {}
    for (kind, votes), n in patterns:
        by_kind.setdefault(kind, []).append((votes, n))
    for kind, own in sorted(by_kind.items()):
        total = sum(n for _, n in own)
        for _ in range(rounds):
            true = sum(m.posterior[kind, v] * n for v, n in own)
            m.prior[kind] = (true + 1) / (total + 2)
            table: dict[str, dict[int, tuple[float, float]]] = {}
            for j, name in enumerate(LABELERS):
                table[name] = {}
                for vote, (a, b) in (CHECKED if j == check else BELIEF).items():
                    yes = sum(m.posterior[kind, v] * n for v, n in own if v[j] == vote)
                    no = sum((1 - m.posterior[kind, v]) * n for v, n in own if v[j] == vote)
                    table[name][vote] = ((yes + a * lean) / (true + lean), (no + b * lean) / (total - true + lean))
            m.vote[kind] = table
            odds = math.log(m.prior[kind] / (1 - m.prior[kind]))
            for v, _ in own:
                z = odds + sum(math.log(table[name][x][0] / table[name][x][1]) for name, x in zip(LABELERS, v, strict=True))
                m.posterior[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return m


def train_classifier(m: Labeling, rows: list[tuple[str, tuple[int, ...], float, float]], rounds: int = 300, decay: float = 1e-3) -> None:
    """Logistic regression of the soft labels on one-hot features: ``rows`` of (kind, features, candidates, sum of posteriors).

    Each kind starts from its own share of true spans; kinds without candidates are never asked.
    """
    m.bias = dict.fromkeys(KINDS, 0.0)
    m.weights = {f: [0.0] * n for f, n in FEATURES.items()}
    if not rows:
        return
    # one column of a kind, then one of each value of each feature
    first = len(KINDS) + np.cumsum([0, *FEATURES.values()])[:-1]
    at = np.array([[KINDS.index(k), *(first + np.array(values))] for k, values, _, _ in rows])
    n, true = (np.array([r[i] for r in rows], dtype=float) for i in (2, 3))
    w = np.zeros(len(KINDS) + sum(FEATURES.values()))
    for k in np.unique(at[:, 0]).tolist():
        own = at[:, 0] == k
        w[k] = math.log((true[own].sum() + 0.5) / ((n - true)[own].sum() + 0.5))
    kept = np.where(np.arange(len(w)) < len(KINDS), 1.0, 1.0 - decay)
    for _ in range(rounds):
        miss = (true - n / (1 + np.exp(-w[at].sum(axis=1)))) / n.sum()
        w = w * kept + np.bincount(at.ravel(), weights=np.repeat(miss, at.shape[1]), minlength=len(w))
    m.bias = {k: float(x) for k, x in zip(KINDS, w, strict=False)}
    m.weights = {f: w[i : i + size].tolist() for i, (f, size) in zip(first, FEATURES.items(), strict=True)}


def learn(found: DataFrame) -> Labeling:
    """Reliabilities and classifier from all candidates; two aggregations, each with a proven bound, come to the driver."""
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counted = each.groupBy("kind", *LABELERS).count().collect()
    patterns = sorted(((r["kind"], tuple(r[k] for k in LABELERS)), r["count"]) for r in counted)
    m = aggregate_votes(patterns)
    if not patterns:
        train_classifier(m, [])
        return m
    table = [(k, *votes, p) for (k, votes), p in m.posterior.items()]
    soft = found.sparkSession.createDataFrame(table, ", ".join(["kind string", *[f"{k} int" for k in LABELERS], "p double"]))
    by = each.join(F.broadcast(soft), ["kind", *LABELERS]).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("p").alias("true"))
    rows = sorted((r["kind"], tuple(r[f] for f in FEATURES), float(r["n"]), r["true"]) for r in by.collect())
    train_classifier(m, rows)
    return m


# ---- decisions


def _score(m: Labeling, c: Column) -> Column:
    listed = lambda ws: F.array(*[F.lit(float(w)) for w in ws])
    z = F.get(listed([m.bias[k] for k in KINDS]), c["rank"])
    for f, ws in m.weights.items():
        z = z + F.get(listed(ws), c[f])
    return z


def _free(spans: Column) -> Column:
    """Of spans in order of start: those of base kinds, and the others that overlap none of them."""
    last = _running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
    back = F.reverse(F.transform(spans, lambda s: F.when(s["base"], -s["start"]).otherwise(F.lit(-(2**31) + 1))))
    following = F.reverse(_running(back, lambda a, b: F.greatest(a, b), F.lit(-(2**31) + 1)))
    pairs = F.zip_with(spans, F.zip_with(last, following, lambda a, b: F.struct(a.alias("last"), b.alias("next"))), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    stay = F.filter(pairs, lambda x: x["s"]["base"] | ((x["e"]["last"] <= x["s"]["start"]) & (-x["e"]["next"] >= x["s"]["end"])))
    return F.transform(stay, lambda x: x["s"])


def _leftmost(spans: Column, block: int = 128) -> Column:
    """Of spans in order of start: base spans, and of the others the leftmost of those that overlap."""

    def step(acc: Column, s: Column) -> Column:
        fits = ~s["base"] & (s["start"] >= acc["at"])
        return F.struct(F.when(fits, s["end"]).otherwise(acc["at"]).alias("at"), F.concat(acc["keep"], F.when(fits | s["base"], "1").otherwise("0")).alias("keep"))

    def over(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), F.lit("").alias("keep")), step)
        # one character a span and one string a block, so that what is copied at each step stays small
        return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["keep"], F.array(x["keep"])).alias("keep")))

    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(spans), F.lit(1)) - 1) / block).cast("int"))
    parts = F.transform(numbers, lambda b: F.slice(spans, b * block + 1, F.lit(block)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("keep"))
    keep = F.split(F.array_join(F.aggregate(parts, none, over, lambda acc: acc["keep"]), ""), "")
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), keep.alias("k")), lambda x: x["k"] == "1"), lambda x: x["s"])


def classify(found: DataFrame, model: Labeling) -> DataFrame:
    """doc_id, ``base``: base spans, and ``spans``: these and the others that the classifier takes, in order."""
    base = F.filter("found", lambda c: c["base"])
    more = F.filter("found", lambda c: ~c["base"] & (c["rank"] >= len(BASE)) & (_score(model, c) > 0))
    rows = found.select("doc_id", F.array_sort(base).alias("base"), more.alias("more"))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "more")))
    rows = rows.withColumn("open", F.when((F.size("more") > 0) & (F.size("base") > 0), _free(F.col("all"))).otherwise(F.col("all")))
    return rows.select("doc_id", "base", F.when(F.size("more") > 1, _leftmost(F.col("open"))).otherwise(F.col("open")).alias("spans"))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base (array of base spans) and spans (all), each struct(start, rank, kind, end, ...)."""
    found = written(candidates(docs, **options), "pii")
    return classify(found, learn(found))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas, in order of start and kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
