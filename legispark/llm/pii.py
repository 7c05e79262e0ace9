"""Personal data: exact base rules, and spans added by boosted trees over high-recall candidates (native).

Generators of high recall propose spans that may overlap: plain and obfuscated addresses, dotted and defanged numbers,
digit groups of any separator, tokens. Trees boosted on format and context features score each one; a calibrated
threshold decides which join the exact ones.

No text says what is personal, so several weak rules vote on each candidate, for or against: the base rules, failed
format checks, words that introduce such data or something else, quotes and assignments around it, the shape of a
token. Votes that do not balance make a candidate an example; the trees see its format and context, never a vote, and
so judge also the many candidates on which the rules are silent or at odds, such as an address written with "at" or a
telephone number without its plus. All features are small numbers, so the examples of any corpus are a table of feature
combinations with counts, whose size the feature ranges bound; boosting runs over that table, exactly, for all rows. The
trees are applied as an SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.llm.storage import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
# Possessive forms of the base patterns: they find the same matches without backtracking over long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators; candidates of "number" are told apart into card and phone by their digits.
GENERATORS = {
    "email": r"(?<![^\s@<>()\[\]\"'{}])[^\s@<>()\[\]\"'{}]++(?:@|\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20(?=[A-Za-z0-9-]++(?:\x20dot\x20|\x20?[\[({]dot)))[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.:])[0-9]++(?:(?:[.:]|\[\.\]|\(\.\))[0-9]++){3}",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{24,}+",
}
# Words that introduce a kind, and words that introduce other numbers.
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|reach (me|us))\W{0,3}(at|is|:)?\W{0,3}$",
    "ip": r"(?i)\b(ip|host|server|addr(ess)?|ping|from)\W{0,4}$",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay(ment)?)\W{0,2}(no|number|nr|is)?\W{0,4}$",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial)\W{0,2}(no|number|nr|me|us|is|at)?\W{0,4}$",
    "secret": r"(?i)(token|key|secret|passw(or)?d|auth|credential)\W{0,4}$",
}
OTHER = r"(?i)\b(isbn|issn|version|ver|v|no|nr|art|section|page|order|invoice|item|sku|id|ref|total|doi)\W{0,4}$|[$\u20AC\u00A3#]\x20?$"
FEATURES = ("generator", "length", "digits", "marks", "plus", "opening", "closing", "hex", "spread", "context")
SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
ROUNDS, RATE, LEAST_PRECISION = 40, 0.3, 0.9
#: Matches that are gathered at a time.
BLOCK = 256
NO_SPANS = "array<struct<kind:string,start:int,end:int>>"
CANDIDATES = "array<struct<kind:string,start:int,end:int,votes:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """All matches, left to right, with their places in code points and the text around them."""

    def step(a: Column, x: Column) -> Column:
        match, gap, following = x["m"], x["g"], x["f"]
        start = a["at"] + F.length(gap)
        end = start + F.length(match)
        span = F.struct(start.alias("start"), end.alias("end"), match.alias("match"), F.substring(gap, -24, 24).alias("before"), F.substring(following, 1, 4).alias("after"))
        return F.when(match.isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    # Appending copies an array, so matches are gathered in blocks and the blocks are joined once: a text of n matches
    # costs about n * (BLOCK + n / BLOCK / BLOCK) copies.
    def gathered(around: Column) -> Column:
        def block(a: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(around, k * BLOCK + 1, BLOCK), F.struct(a["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(around) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), block, lambda a: F.flatten(a["out"]))

    # One more gap than matches: the text after the last one, whose match is null.
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    zipped = lambda v: F.arrays_zip(v["m"].alias("m"), v["g"].alias("g"), F.slice(v["g"], 2, 1 << 30).alias("f"))
    return let(parts, lambda v: let(zipped(v), gathered))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(13, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct(kind, start, end)> of the base rules, by kind and start. A match that fails its check is dropped."""
    likely = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def of_kind(kind: str) -> Column:
        kept = F.filter(find_all(text, BASE[kind]), lambda s: _valid(kind, s["match"]))
        return F.when(likely[kind], F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(empty)

    return F.concat(*map(of_kind, BASE))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _edge(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^[\s]$"), 1).when(c.rlike("^[\"'=:]$"), 2).when(c.rlike(r"^[\p{L}0-9]$"), 3).otherwise(4)


def _bucket(x: Column, *limits: float) -> Column:
    out = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        out = F.when(x < limits[k], k).otherwise(out)
    return out


def _is(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def _votes(name: str, kind: Column, s: Column, n_digits: Column) -> Column:
    """The sum of the weak rules' votes but for the base rules': what introduces the span, what is around it, and whether its format can be."""
    match, before, after = s["match"], s["before"], s["after"]
    introduced = before.rlike(CUES[name]) if name != "number" else F.when(kind == "card", before.rlike(CUES["card"])).otherwise(before.rlike(CUES["phone"]))
    votes = 2 * _is(introduced) - _is(before.rlike(OTHER)) - _is(after.rlike(r"^\x20?(%|\u20AC|\$|km|kg|GB|MB)"))
    if name == "email":
        return votes - 2 * _is(~F.regexp_replace(match, r"\W+dot\W+", ".").rlike(r"[A-Za-z]{2,}$")) + _is(match.rlike(r"\Wat\W.*\Wdot\W"))
    if name == "ip":
        plain = F.regexp_replace(match, r"[\[\]()]", "")
        return votes - 2 * _is(~_valid("ip", F.regexp_replace(plain, ":", "."))) - 2 * _is(plain.contains(":")) + _is(match.rlike(r"[\[(]"))
    if name == "number":
        digits = _digits(match)
        fails = F.when(kind == "card", ~F.when(n_digits <= 19, luhn(digits)).otherwise(False)).otherwise(~n_digits.between(9, 15))
        dates = match.rlike(r"^(19|20)[0-9]{2}[-.\x20][0-9]{2}[-.\x20][0-9]{2}|^[0-9]{2}\.[0-9]{2}\.(19|20)[0-9]{2}")
        return votes - 2 * _is(fails) - 2 * _is(dates) - 2 * _is(match.rlike(r"^[0-9]+$") & (kind == "phone"))
    assigned = before.rlike(r"[=:]\x20?[\"']$") & after.rlike("^[\"']")
    mixed = (match.rlike("[A-Z]") & match.rlike("[a-z]")).cast("int") + match.rlike("^(?i)[0-9a-f]{32,}$").cast("int")
    words = match.rlike("^[0-9]*([a-z]{2,}[-_]|[A-Z]{2,}[-_]|[A-Z]?[a-z]{3,}[-_])+")
    return votes + _is(assigned) + F.least(mixed, F.lit(1)) - 2 * _is(words) - 2 * _is(n_digits == F.length(match))


def candidate_spans(text: Column) -> Column:
    """array<struct(kind, start, end, votes and features)> of all generators."""

    def proposed(g: int, name: str, pattern: str) -> Column:
        likely = text.contains("@") | text.rlike(r"(?i)[\[({\x20]at[\])}\x20]") & text.rlike(r"(?i)[\[({\x20]dot[\])}\x20]") if name == "email" else text.rlike("[0-9]")

        def features(s: Column) -> Column:
            match, n = s["match"], F.length(s["match"])
            n_digits = F.length(_digits(match))
            kind = F.when(n_digits >= 13, "card").otherwise("phone") if name == "number" else F.lit(name)
            cues = F.coalesce(*(F.when(s["before"].rlike(p), k + 1) for k, p in enumerate(CUES.values())), F.when(s["before"].rlike(OTHER), len(CUES) + 1), F.lit(0))
            parts = [
                F.lit(g).alias("generator"),
                _bucket(n, 9, 12, 16, 17, 20, 32, 48).alias("length"),
                _bucket(n_digits / F.greatest(n, F.lit(1)), 0.05, 0.2, 0.5, 0.8, 0.95).alias("digits"),
                _bucket(F.length(F.regexp_replace(match, r"[\p{L}0-9]", "")), 1, 2, 3, 4, 6).alias("marks"),
                F.when(match.startswith("+"), 2).when(match.startswith("("), 1).otherwise(0).alias("plus"),
                _edge(F.substring(s["before"], -1, 1)).alias("opening"),
                _edge(F.substring(s["after"], 1, 1)).alias("closing"),
                F.when(match.rlike("^[0-9]+$"), 2).when(match.rlike("^(?i)[0-9a-f]+$"), 1).otherwise(0).alias("hex"),
                _bucket(F.size(F.array_distinct(F.split(match, ""))), 4, 7, 10, 14).alias("spread"),
                cues.alias("context"),
            ]
            return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _votes(name, kind, s, n_digits).alias("votes"), *parts)

        return F.when(likely, F.transform(find_all(text, pattern), features)).otherwise(F.array().cast(CANDIDATES))

    return F.concat(*(proposed(g, name, pattern) for g, (name, pattern) in enumerate(GENERATORS.items())))


def _overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


class Trees:
    """Depth-two trees over the features, their sum, and the threshold on it that calibration chose."""

    def __init__(self, bias: float, trees: list[tuple], threshold: float):
        self.bias, self.trees, self.threshold = bias, trees, threshold

    def score(self, feature) -> Column:
        """The sum of all trees, as an expression over ``feature(name)``."""
        out = F.lit(self.bias)
        for (f, t), (fl, tl, a, b), (fr, tr, c, d) in self.trees:
            left = F.when(feature(FEATURES[fl]) <= tl, a).otherwise(b)
            right = F.when(feature(FEATURES[fr]) <= tr, c).otherwise(d)
            out = out + F.when(feature(FEATURES[f]) <= t, left).otherwise(right)
        return out

    def of(self, x: tuple) -> float:
        out = self.bias
        for (f, t), (fl, tl, a, b), (fr, tr, c, d) in self.trees:
            out += (a if x[fl] <= tl else b) if x[f] <= t else (c if x[fr] <= tr else d)
        return out


def _split(rows: list[tuple], grad: list[float], hess: list[float], which: list[int]) -> tuple[int, int, float, float, float]:
    """The best split (feature, threshold) of some rows by second-order gain, with the values of both sides."""
    g0, h0 = sum(grad[i] for i in which), sum(hess[i] for i in which)
    best = (0, 99, RATE * g0 / (h0 + 1), 0.0, 0.0)
    for f in range(len(rows[0])):
        sums: dict[int, list[float]] = {}
        for i in which:
            s = sums.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        g, h = 0.0, 0.0
        for value in sorted(sums)[:-1]:
            g, h = g + sums[value][0], h + sums[value][1]
            gain = g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1)
            if gain > best[4] + 1e-9:
                best = (f, value, RATE * g / (h + 1), RATE * (g0 - g) / (h0 - h + 1), gain)
    return best


def _calibrate(held: list[tuple[float, int, int]], steps: int = 30) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve of held-out cases (score, n, positives), drawn to slope 1 and intercept 0 as by one case each."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = 1.0 - a, -b, 1.0, 0.0, 1.0
        for s, n, p in held:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * s + b))))
            w = n * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + (p - n * q) * s, gb + p - n * q, haa + w * s * s, hab + w * s, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a + max(-1.0, min(1.0, da))), b + max(-1.0, min(1.0, db))
    return a, b


def boost(table: list[tuple[tuple, int, int, int]]) -> Trees:
    """Trees from rows (features, fold, n, positives): fold 0 calibrates, the others train.

    The threshold is the score at which a logistic curve, fitted to fold 0 with a prior of one case, says
    ``LEAST_PRECISION``. Counts begin at one case for and one against, so the rule holds for any number of cases, none
    included: then nothing is selected.
    """
    train = [(x, n, p) for x, fold, n, p in table if fold] or [(x, n, p) for x, fold, n, p in table]
    total, positive = sum(n for _, n, _ in train), sum(p for _, _, p in train)
    bias = math.log((positive + 1) / (total - positive + 1))
    rows, score, trees = [x for x, _, _ in train], [bias] * len(train), []
    for _ in range(ROUNDS if rows else 0):
        prob = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        # One case for and one against are spread over all rows, so that few examples never make a sure tree.
        grad = [p - n * q + (1 - 2 * q) / len(train) for (_, n, p), q in zip(train, prob, strict=True)]
        hess = [(n + 2 / len(train)) * q * (1 - q) for (_, n, _), q in zip(train, prob, strict=True)]
        f, t, *_ = _split(rows, grad, hess, list(range(len(rows))))
        sides = [[i for i, x in enumerate(rows) if x[f] <= t], [i for i, x in enumerate(rows) if x[f] > t]]
        left, right = (_split(rows, grad, hess, s)[:4] if s else (0, 99, 0.0, 0.0) for s in sides)
        trees.append(((f, t), left, right))
        for (fs, ts, a, b), side in zip((left, right), sides, strict=True):
            for i in side:
                score[i] += a if rows[i][fs] <= ts else b
    model = Trees(bias, trees, math.inf)
    slope, intercept = _calibrate([(model.of(x), n, p) for x, fold, n, p in table if not fold])
    model.threshold = (math.log(LEAST_PRECISION / (1 - LEAST_PRECISION)) - intercept) / slope
    return model


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates, fold) per row, written down, so that fitting and selecting read no text again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = text.rlike(r"[0-9@]|(?i)[\[({\x20]at[\])}\x20]")
    found = docs.select(
        "doc_id",
        F.coalesce(F.when(likely, base_spans(text)), F.array().cast(NO_SPANS)).alias("base"),
        F.coalesce(F.when(likely, candidate_spans(text)), F.array().cast(CANDIDATES)).alias("candidates"),
        ((F.crc32(text.cast("binary")) % 4) != 0).cast("int").alias("fold"),
    )
    return materialize(found, "candidates")


def learn(scanned: DataFrame) -> Trees:
    """Count feature combinations of all examples of all rows, then boost. At most some ten thousand combinations can occur; they alone come to the driver."""
    each = scanned.select("base", "fold", F.explode("candidates").alias("c"))
    votes = F.col("c.votes") + 2 * _overlaps(F.col("c"), F.col("base")).cast("int")
    table = each.filter(votes != 0).groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES), "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(votes > 0).alias("p"))
    k = len(FEATURES)
    return boost(sorted((tuple(r[:k]), r[k], r[k + 1], r[k + 2]) for r in table.collect()))


def select(scanned: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, base, spans) from what ``scan`` found: selected candidates join if they overlap no base span and no selected candidate before them by kind and start."""
    picked = F.filter("candidates", lambda c: ~_overlaps(c, F.col("base")) & (trees.score(lambda f: c[f]) >= trees.threshold))
    ordered = F.sort_array(F.transform(picked, lambda c: F.struct(_rank(c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    added = F.when(F.size(plain) == 0, F.array().cast(NO_SPANS)).otherwise(F.aggregate(plain, F.array().cast(NO_SPANS), lambda a, c: F.when(_overlaps(c, a), a).otherwise(F.concat(a, F.array(c)))))
    df = scanned.select("doc_id", "base", added.alias("_added"))
    return df.select("doc_id", "base", F.concat(*(F.sort_array(of_kind(F.concat("base", "_added"), k)) for k in KINDS)).alias("spans"))


def _rank(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, n) for n, k in enumerate(KINDS)), F.lit(len(KINDS)))


def fit(docs: DataFrame) -> Trees:
    """Trees learned from all rows of ``docs``; only the text is read. A null text is empty; an empty table gives trees that select nothing."""
    return learn(scan(docs))


def find_personal_data(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, base, spans) per row: the base spans, and all spans, by kind in the order of ``KINDS``, then by start.

    Reads doc_id and text, whatever else there is; a null text counts as empty; repeated rows give equal results; an
    empty table gives none.
    """
    return select(scan(docs), trees)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
