"""Personal data by weak supervision.

Base spans come from four fixed patterns (email, ip, card, phone). Further
candidates (secrets: access keys, assigned passwords and tokens, long hex
strings; telephone numbers without a plus sign) are proposed widely. Three
labelers vote on every candidate, base or not: a strict regex, a gazetteer
(top-level domains, card issuers, calling codes, marker words) and the
context (neighbouring characters, cue words, version numbers); each says yes,
no or nothing. Expectation-maximisation estimates each kind's prior and each
labeler's sensitivity and specificity from the counts of vote patterns, and a
logistic span classifier is then trained on the posteriors. Base spans stay;
other candidates stay if the classifier accepts them. A number within a base
span, however long, is not proposed again.

All of it is DataFrame functions. Texts are read once; the candidates, an
array in each document's row, are stored. EM and the classifier run on counts
of distinct patterns (at most 27 votes x 2^6 features a kind).

Patterns are written so that matching takes linear time: a run of characters
is tried at its start only, and loops never give back. Positions are code
points; running sums in blocks keep a text with very many matches from
costing their square.

Defined cases: null text is empty; documents without candidates have empty
spans; rows may repeat and are handled each by itself; without candidates of
a kind nothing is learned for it, and nothing added; extra columns stay, but
for those with the names of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import stored

KINDS = ["email", "ip", "card", "phone", "secret"]
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Fixed patterns, in the form that needs no second try.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The base spans of phones (8 to 15 digits after the plus sign), matched first, so that nothing in them is proposed.
_PLUS = r"\+[0-9](?:[ ().-]*+[0-9]){7,14}+(?![ ().-]*+[0-9])"
MORE = {
    "phone": rf"{_PLUS}|" r"(?<![0-9A-Za-z+(.-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
              r"|(?<![0-9A-Za-z])(?:password|passwd|secret|token|api_key) ?[=:] ?\"?[0-9A-Za-z_/+.-]{8,}+\"?"
              r"|(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])",
}
#: A character that every match holds: texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "secret": r"(?i)(?:password|passwd|secret|token|key)",
}
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl"
CALLING = "1|33|34|39|41|43|44|49|52|54|55|61|81|86|91"
BLOCK = 256
NEAR = 24  # characters of context on each side


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """(start, end, body, left, right) of each match: what lies between the
    matches gives the positions, by running sums in blocks."""
    def of(both: Column) -> Column:
        pieces, matches = both["p"], both["m"]
        n = F.size(matches)
        lens = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("bigint"))

        def spans(x: Column) -> Column:
            lens_, heads = x["lens"], x["heads"]

            def span(m: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                before = F.get(heads, block) + F.aggregate(F.slice(lens_, block * BLOCK + 1, i % BLOCK), F.lit(0).cast("bigint"), lambda a, v: a + v)
                left = F.get(pieces, i)
                start = before + F.length(left)
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("body"),
                                F.right(left, F.lit(NEAR)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(NEAR)).alias("right"))

            return F.transform(matches, span)

        def heads(lens_: Column) -> Column:
            zero = F.array(F.lit(0).cast("bigint"))
            block_sum = lambda b: F.aggregate(F.slice(lens_, b * BLOCK + 1, BLOCK), F.lit(0).cast("bigint"), lambda a, v: a + v)
            return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), zero, lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + block_sum(b))))

        return F.when(n > 0, _let(lens, lambda v: _let(F.struct(v.alias("lens"), heads(v).alias("heads")), spans)))

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(both, of))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def valid(kind: str, body: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return body.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(body))
        return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(body))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(body)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def votes(kind: str, s: Column) -> Column:
    """What the regex, the gazetteer and the context say: 1 yes, 0 no, 2 nothing."""
    body, left, right = s["body"], s["left"], s["right"]
    strict = {
        "email": body.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$"),
        "ip": body.rlike(r"^(?:(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
        "card": valid("card", body),
        "phone": body.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}$"),
        "secret": body.rlike(r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,}"),
    }[kind]
    known, unknown = {
        "email": (body.rlike(rf"(?i)\.(?:{DOMAINS})$"), F.lit(False)),
        "ip": (F.lit(False), body.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")),
        "card": (body.rlike("^(?:3[47]|4|5[1-5]|6)"), ~body.rlike("^[2-6]")),
        "phone": (body.rlike(rf"^\+(?:{CALLING})(?![0-9])"), body.rlike(r"^\+0")),
        "secret": (body.rlike("^(?:AKIA|password|passwd|secret|token|api_key)"), F.lit(False)),
    }[kind]
    cue = left.rlike(CUES[kind])
    free = ~left.rlike(r"[\p{L}\p{N}]$") & ~right.rlike(r"^[\p{L}\p{N}]")
    version = left.rlike(r"(?i)\b(?:v|ver|version|section|no)\.? *$") | right.rlike(r"^\.[0-9]")
    return F.array(_vote(strict, ~strict), _vote(known, unknown), _vote((cue | free) & ~version, ~free | version))


def shape(s: Column) -> Column:
    """What the classifier sees of a span: a constant and five properties."""
    body = s["body"]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.length(body)
    return F.array(F.lit(1.0), flag(2 * F.length(_digits(body)) > n), flag(n >= 16), flag(body.rlike("[A-Z]")),
                   flag(~s["left"].rlike(r"[\p{L}\p{N}]$") & ~s["right"].rlike(r"^[\p{L}\p{N}]")), flag(body.rlike("[@=.()\"]")))


def _entries(found: Column, kind: str, base: bool) -> Column:
    """The candidates among the matches of one pattern."""
    def entry(s: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.lit(base).alias("base"), votes(kind, s).alias("votes"), shape(s).alias("shape"))

    return F.transform(F.filter(found, lambda s: valid(kind, s["body"]) if base else ~s["body"].startswith("+")), entry)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``_spans``: (kind, start, end, base,
    votes, shape) of all candidates, by kind and start."""
    docs = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,shape:array<double>>>")
    parts = []
    for i, (kind, base, pattern) in enumerate([*((k, True, p) for k, p in BASE.items()), *((k, False, p) for k, p in MORE.items())]):
        found = located(F.col("_t"), pattern)
        if kind in NEEDS and base:
            found = F.when(F.col("_t").contains(NEEDS[kind]), found)
        docs = docs.withColumn(f"_m{i}", found)
        parts.append(F.coalesce(_entries(F.col(f"_m{i}"), kind, base), none))
    drop = ["_t", *(f"_m{i}" for i in range(len(parts)))]
    return docs.withColumn("_spans", F.array_sort(F.concat(*parts))).drop(*drop)


def reliabilities(patterns: Column, rounds: int = 30) -> Column:
    """EM over (votes, n): (prior, yes: P(1 | true), no: P(0 | false)) of a
    kind; ten imagined votes at 0.9 keep labelers without evidence in place."""
    def posterior(m: Column, v: Column) -> Column:
        def side(rate: str, hit: int, p: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.lit(2)), p, lambda a, j: a * F.when(F.get(v, j) == 2, 1.0).when(F.get(v, j) == hit, F.get(m[rate], j)).otherwise(1.0 - F.get(m[rate], j)))
        return _let(F.struct(side("yes", 1, m["prior"]).alias("t"), side("no", 0, 1.0 - m["prior"]).alias("f")), lambda x: x["t"] / (x["t"] + x["f"]))

    def step(m: Column, _: Column) -> Column:
        def maximise(q: Column) -> Column:
            def rate(hit: int, j: Column, weight) -> Column:
                said = _sum(F.transform(q, lambda x: F.when(F.get(x["votes"], j) == hit, weight(x)).otherwise(0.0)))
                spoke = _sum(F.transform(q, lambda x: F.when(F.get(x["votes"], j) != 2, weight(x)).otherwise(0.0)))
                return (said + 9.0) / (spoke + 10.0)

            true, false = (lambda x: x["n"] * x["q"]), (lambda x: x["n"] * (1.0 - x["q"]))
            every = F.sequence(F.lit(0), F.lit(2))
            return F.struct(((_sum(F.transform(q, true)) + 1.0) / (_sum(F.transform(q, lambda x: x["n"].cast("double"))) + 2.0)).alias("prior"),
                            F.transform(every, lambda j: rate(1, j, true)).alias("yes"), F.transform(every, lambda j: rate(0, j, false)).alias("no"))

        return _let(F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(m, p["votes"]).alias("q"))), maximise)

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.9), 3).alias("yes"), F.array_repeat(F.lit(0.9), 3).alias("no"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return _let(model, lambda m: F.struct(m.alias("model"), F.transform(patterns, lambda p: F.struct(p["shape"].alias("shape"), p["n"].alias("n"), posterior(m, p["votes"]).alias("q"))).alias("soft")))


def accept(weights: Column, seen: Column) -> Column:
    """The classifier's probability for a span of this shape."""
    return 1.0 / (1.0 + F.exp(-_sum(F.zip_with(weights, seen, lambda w, x: w * x))))


def classifier(soft: Column, rounds: int = 60, rate: float = 2.0, shrink: float = 0.001) -> Column:
    """Logistic regression on the posteriors ``soft`` (shape, n, q), by gradient."""
    total = _sum(F.transform(soft, lambda x: x["n"].cast("double")))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(soft, lambda x: F.struct(x["shape"].alias("shape"), (x["n"] * (x["q"] - accept(w, x["shape"])) / total).alias("e")))
        return _let(errors, lambda es: F.transform(w, lambda v, j: v * (1.0 - shrink) + rate * _sum(F.transform(es, lambda e: e["e"] * F.get(e["shape"], j)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), 6), step)


def train(spans: DataFrame) -> DataFrame:
    """One row per kind: (kind, model, weights), from all candidates."""
    counts = spans.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "shape", "n"))).alias("patterns"))
    learned = kinds.withColumn("em", reliabilities(F.col("patterns")))
    return learned.select("kind", F.col("em.model").alias("model"), classifier(F.col("em.soft")).alias("weights"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``_base`` and ``_all``: arrays of
    (kind, start, end), by kind and start."""
    spans = stored(candidates(docs, text), "candidates")
    models = stored(train(spans), "span-models")  # one row per kind
    weights = models.agg(F.map_from_entries(F.collect_list(F.struct("kind", "weights")))).scalar()
    spans = spans.withColumn("_w", weights)
    base = F.filter("_spans", lambda s: s["base"])
    plain = lambda a: F.transform(a, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"], s["end"]))
    good = F.filter("_spans", lambda s: s["base"] | (accept(F.col("_w")[s["kind"]], s["shape"]) >= 0.5))
    return spans.withColumn("_base", plain(base)).withColumn("_all", plain(good)).drop("_spans", "_w")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
