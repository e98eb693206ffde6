"""Personal data in texts, by weak supervision, in DataFrame expressions alone.

Exact patterns give the base spans: e-mail addresses, IP addresses, card and phone numbers.
Wider patterns give candidates beside them: card and phone numbers that run into digits
next to them, numbers without a country code, spelt-out addresses, identity numbers, names.

Labelers look at a candidate and vote that it is personal data, that it is not, or not at
all: its exact pattern, its check digits, its shape, its edges, words around it, and lists
of names, domains and country codes. How candidates vote is counted over all texts, a row
for each combination of votes. Expectation-maximisation over these counts estimates how
reliable each labeler is and how likely each combination stands for personal data, and a
logistic classifier of spans is fitted to that. Candidates it accepts join the base spans.

Every text is a row of its own throughout: spans are arrays, and nothing is shuffled but
the counts of combinations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of spans: those with a base pattern, then the others.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "name")

# The patterns take possessive repeats and look behind them, so that a search is linear in
# the text; they match what the plain patterns do, because nothing a repeat gives back could
# be matched by what follows it, and where a run fails, its later parts fail as well.
_LOCAL = "A-Za-z0-9._%+-"
_AFTER_MATCH = r"(?:\G|(?<![{}]))"
_PATTERNS = {
    "email": _AFTER_MATCH.format(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": "(?=[0-9])" + _AFTER_MATCH.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Strict forms inside a match that is no base span.
_INSIDE = {
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])",
    "phone": (r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
              r"(?![0-9])"),
}
_EDGE = r"(?=[0-9(])(?<![0-9A-Za-z.+-])"
_BEGIN = r"(?=\p{Lu})(?<!\p{L})"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Se[nñ]ora?)\.?"
_WORD = r"\p{Lu}[\p{Ll}]{2,20}+"

#: Given names, top domains, country codes and words of context.
GIVEN_NAMES = (
    "Alexander", "Alice", "Andreas", "Andrew", "Anthony", "Barbara", "Carlos", "Catherine",
    "Charles", "Charlotte", "Christian", "Christopher", "Claire", "Daniel", "David", "Deborah",
    "Donald", "Dorothy", "Edward", "Elizabeth", "Emily", "Emma", "Fernando", "François",
    "George", "Hannah", "Helen", "Isabel", "Jacques", "James", "Jason", "Javier", "Jennifer",
    "Jessica", "Johannes", "John", "Joseph", "Julia", "Karen", "Kenneth", "Kevin", "Laura",
    "Linda", "Lisa", "Margaret", "Maria", "Marie", "Martin", "Mary", "Matthew", "Michael",
    "Michelle", "Nancy", "Nicolas", "Olivia", "Patricia", "Paul", "Peter", "Philippe", "Pierre",
    "Richard", "Robert", "Ryan", "Sabine", "Sandra", "Sarah", "Sophie", "Stefan", "Stephen",
    "Steven", "Susan", "Thomas", "Timothy", "William", "Wolfgang")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "eu", "de",
               "fr", "es", "it", "nl", "be", "at", "ch", "uk", "ie", "us", "ca", "mx", "br",
               "ar", "cl", "co", "jp", "cn", "in", "au", "nz", "ru", "pl", "se", "no", "dk", "fi")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43",
                 "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60",
                 "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351",
                 "352", "353", "358", "420")
_FOR = (r"(?i)(?:e-?mail|mail|contact|write to|call|phone|tel|mobile|fax|ssn|social security|"
        r"passport|my name is|i am|card|visa|payment|ip|address|kontakt|telefon|karte|"
        r"courriel|carte|correo|tarjeta|llame)\W{0,6}(?:\w{1,12}\W{1,3})?$")
_AGAINST = (r"(?i)(?:token|secret|key|hash|sha|md5|isbn|issn|doi|version|order|invoice|build|"
            r"commit|serial|part no|lot|0x)\W{0,8}$")

Let = Callable[[Column], Column]


def let(value: Column, body: Let) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _starts(lengths: Column) -> Column:
    """What lies before each element: sums of lengths, in blocks of 256 and within them."""
    block = 256

    def within(totals: Column) -> Column:
        before = F.transform(totals, lambda _, b: F.aggregate(
            F.slice(totals, 1, b), F.lit(0).cast("long"), lambda s, x: s + x))
        return let(before, lambda sums: F.transform(lengths, lambda _, i: F.get(
            sums, (i / block).cast("int")) + F.aggregate(
            F.slice(lengths, i - i % block + 1, i % block), F.lit(0).cast("long"),
            lambda s, x: s + x)))

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(lengths) - 1) / block).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), F.lit(0).cast("long"),
                              lambda s, x: s + x))
    return let(blocks, within)


_SPAN = ("struct<kind:string,start:bigint,end:bigint,match:string,before:string,"
         "after:string>")
_NONE = f"array<{_SPAN}>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _found(text: Column, kind: str, pattern: str, when: Column, at: Column | None = None,
           before: Column | None = None, after: Column | None = None) -> Column:
    """All matches as spans, leftmost and without overlap, with the text at their edges.

    ``at``, ``before`` and ``after`` say where ``text`` itself stands.
    """
    offset = at if at is not None else F.lit(0).cast("long")

    def spans(gaps: Column) -> Column:
        def of(matches: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: (
                F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("long"))
            return let(lengths, lambda n: let(_starts(n), lambda s: F.transform(
                matches, lambda m, i: one(m, i, F.get(s, i) + F.char_length(F.get(gaps, i))))))

        def one(match: Column, i: Column, start: Column) -> Column:
            lead = F.get(gaps, i)
            if before is not None:
                lead = F.concat(before, F.when(i == 0, lead).otherwise(
                    F.concat(F.lit(" "), lead)))
            trail = F.get(gaps, i + 1)
            if after is not None:
                trail = F.concat(trail, after)
            begin = offset + start
            return F.struct(
                F.lit(kind).alias("kind"), begin.cast("long").alias("start"),
                (begin + F.char_length(match)).cast("long").alias("end"),
                match.alias("match"), F.right(lead, F.lit(40)).alias("before"),
                F.left(trail, F.lit(20)).alias("after"))

        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(F.size(gaps) < 2, _none()).otherwise(
            let(matches, of).cast(_NONE))

    return F.when(when, let(F.split(text, pattern, -1), spans)).otherwise(_none())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    def total(reverse: Column) -> Column:
        def value(i: Column) -> Column:
            digit = F.substr(reverse, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, digit).otherwise(
                digit * 2 - F.when(digit > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.char_length(reverse)), F.lit(0),
                           lambda s, i: s + value(i))
    return let(F.reverse(digits), total) % 10 == 0


def _exact(span: Column, kind: str) -> Column:
    """Whether a match of a base pattern is a base span."""
    match = span["match"]
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    count = F.char_length(_digits(match))
    if kind == "card":
        return F.when(count.between(13, 19), luhn(_digits(match))).otherwise(False)
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """All matches of each base pattern; ``_exact`` tells base spans."""
    numbers = text.rlike("[0-9]")
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
             "ip": text.rlike(r"[0-9]\.[0-9]")}
    return {kind: _found(text, kind, pattern, hints.get(kind, numbers))
            for kind, pattern in _PATTERNS.items()}


def _candidates(text: Column, failed: dict[str, Column]) -> Column:
    """Wider candidates: strict forms inside failed matches, and other writings."""
    numbers = text.rlike("[0-9]")
    def inside(kind: str) -> Column:
        return F.flatten(F.transform(failed[kind], lambda s: _found(
            s["match"], kind, _INSIDE[kind], F.lit(True), s["start"], s["before"], s["after"])))

    local = (_EDGE + r"(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-]"
             r"[0-9]{4}(?![0-9A-Za-z])")
    spelt = (_AFTER_MATCH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?"
             r"[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++)++")
    number = _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
    known = "|".join(GIVEN_NAMES)
    name = rf"{_BEGIN}(?:{_TITLE} (?:{_WORD} )?|(?:{known}) (?:\p{{Lu}}\. )?){_WORD}(?!\p{{L}})"
    return F.concat(
        *map(inside, _INSIDE), _found(text, "phone", local, numbers),
        _found(text, "email", spelt, text.rlike(r"[\[(] ?(?:at|AT) ?[\])]")),
        _found(text, "id", number, numbers),
        _found(text, "name", name, text.rlike(rf"{_BEGIN}(?:{_TITLE}|{known}) \p{{Lu}}")))


# --- labelers -------------------------------------------------------------------------

def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.when(no, -1).otherwise(0) if no is not None else F.lit(0)
    return F.when(yes, 1).otherwise(against)


def votes(s: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 personal data, -1 none, 0 nothing."""
    kind, match, digits = s["kind"], s["match"], _digits(s["match"])
    of = {k: kind == k for k in KINDS}
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    country = F.regexp_extract(match, r"^\+([0-9]{1,3}?)[^0-9]", 1)
    given = F.regexp_extract(match, r"^(\p{L}+)", 1)
    glued = (F.right(s["before"], F.lit(1)).rlike(r"[\p{L}0-9=#/_]")
             | F.left(s["after"], F.lit(1)).rlike(r"[\p{L}0-9#/_=]"))
    check = F.when(of["card"], F.when(luhn(digits), 1).otherwise(-1)).when(
        of["ip"], _vote(match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), F.lit(True))).when(
        of["id"], F.when(match.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1)).otherwise(0)
    shape = F.when(of["card"], _vote(match.rlike(
        r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), F.lit(True))).when(
        of["phone"], _vote(match.rlike(r"[0-9)][ .-][0-9]{3,4}[ .-][0-9]{3,4}$"))).when(
        of["name"], _vote(match.rlike(rf"^{_TITLE} "))).when(
        of["email"], _vote(match.rlike(r"\.[A-Za-z]{2,}$|(?i)dot"), F.lit(True))).otherwise(0)
    listed = F.when(of["email"], _vote(domain.isin(*TOP_DOMAINS))).when(
        of["phone"], _vote(country.isin(*COUNTRY_CODES))).when(
        of["name"], _vote(given.isin(*GIVEN_NAMES))).when(
        of["ip"], F.when(match.rlike(r"^(?:0|127|255)\."), -1).otherwise(0)).otherwise(0)
    pattern = F.when(of["email"], _vote(match.contains("@"))).when(
        of["ip"], F.lit(1)).when(of["card"], _vote(luhn(digits), F.lit(True))).when(
        of["phone"], _vote(F.char_length(digits).between(9, 15), F.lit(True))).otherwise(0)
    return {"pattern": pattern, "check": check, "shape": shape,
            "edges": F.when(glued, -1).otherwise(1), "listed": listed,
            "context": _vote(s["before"].rlike(_FOR)),
            "warning": F.when(s["before"].rlike(_AGAINST), -1).otherwise(0)}


LABELERS = ("pattern", "check", "shape", "edges", "listed", "context", "warning")


# --- model ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """``reliability``: the chance that a labeler is right when it votes; ``weights`` of the
    classifier by (labeler, vote) and kind, and its ``bias``."""

    reliability: dict[str, float]
    weights: dict[tuple[str, int], float]
    kinds: dict[str, float]
    bias: float

    def score(self, span: Column) -> Column:
        """The chance that a span is personal data."""
        total = F.lit(self.bias)
        for name, vote in votes(span).items():
            up, down = self.weights[name, 1], self.weights[name, -1]
            total = total + let(vote, lambda v, u=up, d=down: F.when(v > 0, u).when(
                v < 0, d).otherwise(0.0))
        for kind, weight in self.kinds.items():
            total = total + F.when(span["kind"] == kind, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


#: Counts that a labeler brings along: right eight times in ten votes, as often silent.
_PRIOR = {True: np.array([2.0, 10.0, 8.0]), False: np.array([8.0, 10.0, 2.0])}


def estimate(ballots: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 200
             ) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (chance per ballot, [class, labeler, vote] probabilities).

    ``ballots`` are rows of votes -1, 0 and 1. Given the truth, labelers vote independently;
    how often a kind is personal data is its own number.
    """
    chance = 1 / (1 + np.exp(-1.5 * ballots.sum(axis=1)))
    says = np.stack([ballots == v for v in (-1, 0, 1)], axis=2).astype(float)
    table = np.zeros((2, ballots.shape[1], 3))
    for _ in range(rounds):
        share = np.zeros(len(chance))
        for kind in np.unique(kinds):
            own = kinds == kind
            share[own] = (1 + (counts * chance)[own].sum()) / (2 + counts[own].sum())
        for truth in (False, True):
            weight = counts * (chance if truth else 1 - chance)
            filled = np.tensordot(weight, says, axes=(0, 0)) + _PRIOR[truth]
            table[int(truth)] = filled / filled.sum(axis=1, keepdims=True)
        logs = [np.log(p) + (says * np.log(table[t])).sum(axis=(1, 2))
                for t, p in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - chance).max(initial=0.0) < 1e-9:
            break
        chance = new
    return chance, table


def _fitted(features: np.ndarray, chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights (bias last) by Newton steps, held near zero by a small ridge."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.5)
    ridge[-1] = 0.01
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (chance - p)) - ridge * w
        bend = (x.T * (counts * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(ballots: list[tuple[str, tuple[int, ...], int]]) -> Model:
    """A model from rows of (kind, votes, count)."""
    votes_of = np.array([b for _, b, _ in ballots], dtype=int).reshape(-1, len(LABELERS))
    kinds = np.array([KINDS.index(k) for k, _, _ in ballots], dtype=int)
    counts = np.array([n for _, _, n in ballots], dtype=float)
    chance, table = estimate(votes_of, kinds, counts)
    columns = [(name, v) for name in LABELERS for v in (1, -1)]
    features = np.hstack([
        np.stack([votes_of[:, LABELERS.index(name)] == v for name, v in columns], axis=1),
        np.stack([kinds == k for k in range(len(KINDS))], axis=1)]).astype(float)
    w = _fitted(features, chance, counts)
    rights = {name: float((table[1, i, 2] + table[0, i, 0])
                          / (table[1, i, [0, 2]].sum() + table[0, i, [0, 2]].sum()))
              for i, name in enumerate(LABELERS)}
    return Model(rights, dict(zip(columns, w.tolist(), strict=False)),
                 dict(zip(KINDS, w[len(columns):-1].tolist(), strict=True)), float(w[-1]))


def _spans(documents: DataFrame, text: str, keep: Column) -> DataFrame:
    """Rows of (row, base, wider): what to keep of a row, and its arrays of spans."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = base_spans(content)

    def parts(kind: str, all_of: Column) -> Column:
        return F.struct(F.filter(all_of, lambda s: _exact(s, kind)).alias("good"),
                        F.filter(all_of, lambda s: ~_exact(s, kind)).alias("bad"))

    # A column for each kind: fields of one struct would be computed once for each use.
    parted = documents.select(keep.alias("row"), content.alias("content"), *(
        let(found[k], lambda a, k=k: parts(k, a)).alias(k) for k in BASE))
    base = F.concat(*(F.col(f"{k}.good") for k in BASE))
    wider = _candidates(F.col("content"), {k: F.col(f"{k}.bad") for k in BASE})
    apart = let(base, lambda b: F.filter(wider, lambda s: ~F.exists(
        b, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))
    return parted.select("row", base.alias("base"), apart.alias("wider"))


def learn(documents: DataFrame, text: str = "text") -> Model:
    """The model of all candidates of all texts.

    One row per combination of kind and votes reaches the driver, 13,122 at most.
    """
    every = _spans(documents, text, F.lit(0)).select(
        F.explode(F.concat("base", "wider")).alias("s"))
    counted = every.select(F.col("s.kind").alias("kind"), *(
        v.alias(n) for n, v in votes(F.col("s")).items())).groupBy("kind", *LABELERS).agg(
        F.count(F.lit(1)).alias("n"))
    return fit(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"])
                      for r in counted.collect()))


def _joined(spans: Column) -> Column:
    """Spans by kind and start as text."""
    order = F.transform(spans, lambda s: F.struct(
        F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["start"].alias("start"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(documents: DataFrame, model: Model, text: str = "text",
               least: float = 0.5) -> DataFrame:
    """``documents`` with ``base`` and ``spans``: arrays of spans with kind, start, end and match.

    Places are code points, ends exclusive. Base spans are those of the exact patterns, of
    each kind leftmost and without overlap; they are in ``spans`` whatever the model says.
    Wider candidates join them if they overlap no base span and no earlier kind's or place's
    accepted candidate, and the model's score is at least ``least``. Null texts count as
    empty. Texts count whole: the search is linear in their length, the comparison of wider
    candidates with base spans takes their product. Repeated rows and null keys stay as they
    are; columns named ``base`` or ``spans`` are replaced. An empty table gives none.
    """
    keep = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("base", "spans")]
    found = _spans(documents, text, F.struct(*keep) if keep else F.struct(F.lit(0)))
    accepted = F.filter("wider", lambda s: model.score(s) >= least)
    clear = let(accepted, lambda a: F.filter(a, lambda s, i: ~F.exists(
        F.slice(a, 1, i), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))
    return found.select("row.*", "base", F.concat("base", clear).alias("spans"))


def report(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
           ) -> DataFrame:
    """Per document the number of base spans by kind, a digest of them, and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind))

    found = find_spans(documents.select(key, text), model, text)
    return found.select(
        F.col(f"`{key}`"), *(count(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))
