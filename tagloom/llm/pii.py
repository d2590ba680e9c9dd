"""Personal data: generators propose spans, boosted trees and calibrated thresholds choose.

Four exact rules (mail address, IP address, card, phone) always stay. Generators of high recall
propose more spans, which overlap each other and the rules' spans. Gradient-boosted trees score a
proposal by its format and its context, not by what the rules check (a plus sign, a check digit, a
dotted address). They learn from all proposals of the corpus, those that overlap a rule's span being
positive: a telephone number without its country code looks like the inside of the numbers that have
one. The threshold of each generator is set on the other half of the corpus, which the trees
haven't seen, so that at least ``PRECISION`` of what is selected there is positive (proposals that the
rules don't know count as negative, so the share is a lower bound).

Everything runs as expressions over single rows; training needs one aggregate, whose groups are the
cells of the grid of feature values. The grid is finite, so what reaches the driver is bounded,
whatever the corpus, and the counts in it cover every proposal.

Defined results: NULL and empty texts have no spans. Rows are independent, also repeated ones. A
column of the caller's that is named like the result is replaced; others are kept. Without enough
positive proposals nothing is added to the rules' spans. Offsets count code points, the end is
exclusive. A document's time grows with its length and with proposals times rules' spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# The rules, in the order in which spans of equal start are listed. Each start is
# tried once a run of its characters (or right behind the last match), so that long runs cost linear
# time; the matches are those of the plain patterns.
RULES = (
    (
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
    ),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
KINDS = tuple(name for name, _, _ in RULES) + ("learned",)
# Generators of proposals: runs of digit groups, their parts without a prefix, spelt addresses.
GENERATORS = (
    r"\(?[0-9][0-9().\x20-]{5,40}[0-9]",
    r"(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]\x20?at\x20?[)\]])\x20?[A-Za-z0-9-]{1,64}"
    r"(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[A-Za-z0-9-]{1,64}){1,8}",
)
CONTEXT = (
    r"(?:tel|phone|call|fax|mobile|cell|contact|mail|write|card|visa|account|iban|ssn|social|born"
    r"|address|reach|konto|telefon|correo|appel)[^a-z0-9]{0,4}$"
)
ROUNDS, RATE, SMOOTH, LEAST, PRECISION = 24, 0.3, 1.0, 20, 0.9
_BLOCK = 256

Tree = tuple  # (feature, value, left, right), or a leaf's number


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _before_blocks(lengths: str) -> Column:
    """Sums of all lengths before each block of ``_BLOCK`` lengths.

    An array that grows by one element at a time is copied as often as it has elements; by blocks
    it stays short, and within a block few lengths are added up.
    """
    sums = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")),
        lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
    )
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(sums, start, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def _offsets(lengths: str, before: str) -> Column:
    """Sums of all lengths before each one; ``before`` is the column of ``_before_blocks``."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    return F.transform(
        F.col(lengths),
        lambda _, i: F.get(before, block(i))
        + _total(F.slice(lengths, block(i) * _BLOCK + 1, i % _BLOCK)),
    )


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def _located(parts: str, found: str, start: str) -> Column:
    """``(text, start, end, before, after)`` of the matches of a pattern."""
    return F.transform(
        F.col(found),
        lambda m, i: F.struct(
            m.alias("text"),
            (F.get(start, i) + _length(F.get(parts, i))).alias("start"),
            (F.get(start, i) + _length(F.get(parts, i)) + _length(m)).alias("end"),
            F.lower(F.right(F.get(parts, i), F.lit(24))).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
        ),
    )


def _matches(docs: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """A column of located matches for each pattern, for texts that pass its test."""
    none = F.array().cast("array<string>")
    parts = {
        f"{name}__parts": F.when(test, F.split(F.col(text), pattern, -1)).otherwise(none)
        for name, (pattern, test) in patterns.items()
    }
    found = {
        f"{name}__found": F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        for name, (pattern, test) in patterns.items()
    }
    lengths = {
        f"{n}__lengths": F.zip_with(
            f"{n}__found",
            F.slice(f"{n}__parts", F.lit(1), F.size(f"{n}__found")),
            lambda m, p: _length(m) + _length(p),
        )
        for n in patterns
    }
    before = {f"{n}__before": _before_blocks(f"{n}__lengths") for n in patterns}
    starts = {f"{n}__start": _offsets(f"{n}__lengths", f"{n}__before") for n in patterns}
    located = {n: _located(f"{n}__parts", f"{n}__found", f"{n}__start") for n in patterns}
    out = docs
    for step in (parts | found, lengths, before, starts, located):
        out = out.withColumns(step)
    return out.drop(*parts, *found, *lengths, *before, *starts)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _holds(kind: str, text: Column) -> Column:
    """What a rule asks of a match besides its pattern."""
    n = F.length(_digits(text))
    if kind == "ip":
        part = "0*(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), F.call_function("luhn_check", _digits(text))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _class(char: Column) -> Column:
    """Kind of a neighbouring character; the plus sign isn't told from white space."""
    return (
        F.when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).when(char.rlike(r"[\s+]") | (char == ""), 0)
    ).otherwise(3)


def _features(generator: int, c: Column) -> dict[str, Column]:
    """Format and context of a proposal as small whole numbers."""
    text = c["text"]
    capped = lambda pattern, most: F.least(F.regexp_count(text, F.lit(pattern)), F.lit(most))
    return {
        "generator": F.lit(generator),
        "digits": F.least(F.length(_digits(text)), F.lit(20)),
        "groups": capped("[0-9]+", 6),
        "parens": capped(r"\(", 2),
        "dots": capped(r"\.", 4),
        "dashes": capped("-", 4),
        "spaces": capped(r"\x20", 4),
        "long_group": text.rlike("[0-9]{7}").cast("int"),
        "ending": text.rlike(r"[.)\]]\x20?[A-Za-z]{2,4}$").cast("int"),
        "context": c["before"].rlike(CONTEXT).cast("int"),
        "before": _class(F.right(c["before"], F.lit(1))),
        "after": _class(c["after"]),
    }


FEATURES = (
    "generator digits groups parens dots dashes spaces long_group ending context before after".split()
)


def _spans(matches: str, order: int, kind: str) -> Column:
    """The matches of a rule that hold, as spans."""
    return F.transform(
        F.filter(matches, lambda m: _holds(kind, m["text"])),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("order"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _proposals(matches: str, generator: int) -> Column:
    return F.transform(
        matches,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            *[f.alias(n) for n, f in _features(generator, c).items()],
        ),
    )


def propose(docs: DataFrame, *, text: str = "text", into: str = "personal") -> DataFrame:
    """``docs`` and a struct of ``base`` spans and scored-to-be ``proposals`` in its whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    digit = whole.rlike("[0-9]")
    source = f"{into}__text"
    patterns = {}
    for name, pattern, needs in RULES:
        test = F.col(source).contains(needs) if needs else F.lit(True)
        patterns[f"{into}__{name}"] = (pattern, test & (F.lit(True) if name == "email" else digit))
    for k, pattern in enumerate(GENERATORS):
        test = F.col(source).rlike(r"@|[(\[]\x20?at") if k == 2 else digit
        patterns[f"{into}__g{k}"] = (pattern, test)
    found = _matches(docs.withColumn(source, whole), source, patterns)
    base = F.concat(*[_spans(f"{into}__{name}", k, name) for k, (name, _, _) in enumerate(RULES)])
    proposals = F.concat(*[_proposals(f"{into}__g{k}", k) for k in range(len(GENERATORS))])
    based = found.withColumn(f"{into}__base", F.sort_array(base))
    overlaps = lambda c: F.exists(
        f"{into}__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
    )
    marked = F.transform(proposals, lambda c: c.withField("overlaps", overlaps(c)))
    return based.withColumn(
        into,
        F.struct(
            F.col(f"{into}__base").alias("base"),
            marked.alias("proposals"),
            F.pmod(F.xxhash64(source), F.lit(2)).alias("half"),
        ),
    ).drop(source, *patterns, f"{into}__base")


@dataclass(frozen=True)
class Model:
    """Boosted trees over the features, and the least score of each generator's proposals."""

    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    least: dict[int, float] = field(default_factory=dict)

    def score(self, cell: dict[str, int]) -> float:
        return self.start + sum(_value(t, cell) for t in self.trees)

    def selects(self, c: Column) -> Column:
        """Whether a proposal reaches its generator's threshold."""
        if not self.least:
            return F.lit(False)
        score = F.lit(self.start)
        for tree in self.trees:
            score = score + _expression(tree, c)
        chosen = F.lit(False)
        for generator, least in self.least.items():
            chosen |= (c["generator"] == generator) & (score >= F.lit(least))
        return chosen


def _value(tree: Tree, cell: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        feature, value, left, right = tree
        tree = left if cell[feature] <= value else right
    return tree


def _expression(tree: Tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, value, left, right = tree
    return F.when(c[feature] <= value, _expression(left, c)).otherwise(_expression(right, c))


def _grow(cells: list[tuple[dict, float, float]], depth: int) -> Tree:
    """A tree over cells ``(features, gradient, curvature)``; leaves are Newton steps."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-6, None)
    if depth:
        for feature in FEATURES:
            sums: dict[int, list[float]] = {}
            for cell, a, b in cells:
                both = sums.setdefault(cell[feature], [0.0, 0.0])
                both[0] += a
                both[1] += b
            left_g = left_h = 0.0
            for value in sorted(sums)[:-1]:
                left_g += sums[value][0]
                left_h += sums[value][1]
                right_g, right_h = g - left_g, h - left_h
                gain = (
                    left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - g**2 / (h + SMOOTH)
                )
                if gain > best[0]:
                    best = (gain, (feature, value))
    if best[1] is None:
        return RATE * g / (h + SMOOTH)
    feature, value = best[1]
    left = [c for c in cells if c[0][feature] <= value]
    right = [c for c in cells if c[0][feature] > value]
    return feature, value, _grow(left, depth - 1), _grow(right, depth - 1)


def fit(proposed: DataFrame, *, into: str = "personal") -> Model:
    """Trees from one half of the documents, thresholds from the other one."""
    each = proposed.select(F.col(f"{into}.half").alias("half"), F.explode(f"{into}.proposals").alias("c"))
    counts = each.groupBy("half", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
        F.count_if("c.overlaps").alias("yes"), F.count("*").alias("n")
    )
    halves: dict[int, list] = {0: [], 1: []}
    for row in counts.orderBy("half", *FEATURES).collect():
        halves[row["half"]].append(({f: row[f] for f in FEATURES}, row["yes"], row["n"]))
    yes, n = (sum(c[k] for c in halves[0]) for k in (1, 2))
    if yes < LEAST:
        return Model()
    start = math.log((yes + 1) / (n - yes + 1))
    margins = [start] * len(halves[0])
    trees: list[Tree] = []
    for _ in range(ROUNDS):
        cells = []
        for (cell, y, m), margin in zip(halves[0], margins, strict=True):
            p = 1 / (1 + math.exp(-margin))
            cells.append((cell, y - m * p, m * p * (1 - p)))
        trees.append(_grow(cells, 2))
        margins = [m + _value(trees[-1], c[0]) for c, m in zip(halves[0], margins, strict=True)]
    model = Model(trees, start)
    return Model(trees, start, _thresholds(model, halves[1]))


def _thresholds(model: Model, cells: list) -> dict[int, float]:
    """For each generator the lowest score from which on enough of the other half is positive."""
    least = {}
    for generator in range(len(GENERATORS)):
        scored: dict[float, list[int]] = {}
        for cell, y, n in cells:
            if cell["generator"] == generator:
                both = scored.setdefault(round(model.score(cell), 9), [0, 0])
                both[0] += y
                both[1] += n
        yes = total = 0
        for score in sorted(scored, reverse=True):
            yes += scored[score][0]
            total += scored[score][1]
            if yes >= LEAST and yes >= PRECISION * total:
                least[generator] = score - 1e-6
    return least


def select(proposed: DataFrame, model: Model, *, into: str = "personal") -> DataFrame:
    """``proposed`` with its struct replaced by the array of all spans, by start, then kind.

    A selected proposal is added where it overlaps no rule's span. Of selected proposals that
    overlap each other, the one that starts first, then the longest, is added.
    """
    chosen = F.sort_array(
        F.transform(
            F.filter(f"{into}.proposals", lambda c: ~c["overlaps"] & model.selects(c)),
            lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("last")),
        )
    )
    added = F.transform(
        chosen,
        lambda c: F.struct(
            c["start"].alias("start"),
            F.lit(len(RULES)).alias("order"),
            (-c["last"]).alias("end"),
            F.lit(KINDS[-1]).alias("kind"),
        ),
    )
    apart = F.filter(
        added,
        lambda c: ~F.exists(
            added,
            lambda o: (o["start"] < c["end"])
            & (c["start"] < o["end"])
            & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["end"] > c["end"]))),
        ),
    )
    return proposed.withColumn(into, F.array_sort(F.concat(f"{into}.base", F.array_distinct(apart))))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, joined with commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(found: DataFrame, *, text: str = "text", spans: str = "personal") -> DataFrame:
    """The texts with every span replaced by its kind in brackets; overlapping spans become one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    fold = F.aggregate(
        F.col(spans),
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["done"],
                    F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.lit("["),
                    F.upper(s["kind"]),
                    F.lit("]"),
                ).alias("done"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))),
        lambda acc: F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, fold).otherwise(F.col(text)))
