"""Personal data by candidate gradient boosting (DataFrame functions and Spark ML only).

Base rules find e-mail addresses, IP addresses, card and phone numbers that are written plainly. They miss what is
written otherwise ("name [at] host [dot] com", cards in dotted groups, phones without a country code) and what stands so
close to other digits that their greedy match is dropped. Generators with high recall therefore propose spans, which may
overlap; boosted trees score each proposal by its format and by the text around it; a threshold per kind, calibrated on
held-out proposals for a stated precision, selects; of proposals that overlap, the best stays. Base spans always stay.

Labels come from the corpus itself. All different base spans with the text around them are rewritten: right in
other spellings and beside other digits, wrong with a broken check digit, too large a part, more parts, or words of the
text in place of a name. The generators run on the rewritten text: the proposal that is the rewritten span has its
label, one that overlaps it with other ends is wrong. Proposals with the same features and label are one row with their
number as its weight, so what is fitted grows with the kinds of spans more than with their number. Without base spans there is nothing to learn and nothing is added.

Positions come from the lengths of matches and of what lies between them, so that no text is cut up by index, and all
patterns take runs whole, so that long runs cost linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Precision that a kind's threshold must have on held-out proposals.
PRECISION = 0.99
TREES, DEPTH, STEP = 24, 3, 0.3
#: Code points before and after a span that are its context.
BEFORE, AFTER = 24, 16

# The base rules. A run's start is asked for (or the end of the match before), so that no run is scanned from its middle;
# where a pattern begins with a digit, the digit is asked for first, since most characters are none.
_LOCAL = "[A-Za-z0-9._%+-]"
_FIRST_DIGIT = r"[0-9](?<![0-9][0-9])"
_BASE = {
    EMAIL: rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: rf"{_FIRST_DIGIT}[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: rf"{_FIRST_DIGIT}(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){{11,}}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# What a text with a match of a base rule has in it: texts without are not searched. (A word, or a pattern that is cheap.)
_BASE_NEEDS = {EMAIL: "@", IP: r"[0-9]\.[0-9]", CARD: r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", PHONE: "+"}

# What proposes spans: (kind, what a text must have, pattern). Proposals of one pattern don't overlap, those of different
# patterns may.
_AT = r"(?:[\x20]?@[\x20]?|[\x20]?[\[({][\x20]?(?:at|@)[\x20]?[\])}][\x20]?|[\x20]at[\x20])"
_DOT = r"(?:\.|[\x20]?[\[({][\x20]?(?:dot|\.)[\x20]?[\])}][\x20]?|[\x20]dot[\x20])"
_DEFANGED = r"(?:\.|[\[(]\.[\])]|[\[(]dot[\])])"
_NO_DIGIT_AFTER = "(?![0-9])"
_ADDRESS = r"@|[\[({]\x20?[aA@][tT]?\x20?[\])}]|\x20[aA][tT]\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]|\x20?[\[({]|\x20[dD][oO][tT]\x20)"
_FOUR = r"[0-9][0-9][0-9][0-9]"
_GENERATORS = (
    (EMAIL, _ADDRESS, rf"(?i)(?<!{_LOCAL}){_LOCAL}++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++"),
    (IP, r"[0-9][.\[(]", rf"(?i){_FIRST_DIGIT}[0-9]{{0,2}}+(?:{_DEFANGED}[0-9]{{1,3}}+){{3}}+{_NO_DIGIT_AFTER}"),
    (CARD, _FOUR, rf"{_FIRST_DIGIT}[0-9]{{11,18}}+{_NO_DIGIT_AFTER}"),
    (CARD, _FOUR, rf"{_FIRST_DIGIT}[0-9]{{3}}(?:[\x20.-][0-9]{{4}}[\x20.-][0-9]{{4}}[\x20.-][0-9]{{4}}|[\x20.-][0-9]{{6}}[\x20.-][0-9]{{5}}){_NO_DIGIT_AFTER}"),
    (PHONE, "+", rf"\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[\x20.-]?[0-9]{{3,4}}[\x20.-]?[0-9]{{3,4}}{_NO_DIGIT_AFTER}"),
    (PHONE, "(", rf"\([0-9]{{3}}\)[\x20.-]?[0-9]{{3}}[\x20.-][0-9]{{4}}{_NO_DIGIT_AFTER}"),
    (PHONE, _FOUR, rf"{_FIRST_DIGIT}[0-9]{{2}}[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}{_NO_DIGIT_AFTER}"),
)

_CUE = r"(?i)(?:mail|contact|kontakt|card|visa|credit|karte|carte|tarjeta|tel|phone|call|fax|mobile|host|server|addr|\bip\b)"
_COUNTER_CUE = r"(?i)(?:version|release|isbn|issn|order|invoice|section|serial|sku|part|ref|\bv|\bno|\bid)[\s.:#-]*$"

_FOUND = "struct<m: string, l: string, r: string, start: bigint, end: bigint>"
_SPAN = "array<struct<start: bigint, kind: int, end: bigint, score: double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; what a lambda names from outside is computed for each element anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``op`` over all elements before it (``zero`` first). A fold that appends copies what it has, so
    the array is scanned in pieces of the root of its length, each from the result of the pieces before."""

    def appended(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

    def in_pieces(v: Column, step: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / step).cast("int")), lambda i: F.slice(v, i * step + 1, step))
        return _let(pieces, lambda ps: _let(
            appended(F.transform(ps, lambda p: F.aggregate(p, zero, op)), zero),
            lambda heads: F.flatten(F.transform(ps, lambda p, i: F.slice(appended(p, F.get(heads, i)), F.lit(1), F.size(p)))),
        ))

    return _let(values, lambda v: _let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda step: in_pieces(v, step)))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _found(text: Column, pattern: str, needs: str) -> Column:
    """All matches of a pattern in order: their text, contexts and positions in code points (end exclusive)."""
    none = F.array().cast("array<string>")
    has = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    matches = F.when(has, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none)

    def placed(m: Column, gaps: Column, before: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(
            x.alias("m"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("l"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("r"),
            (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
            (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(x)).alias("end"),
        ))

    def cut(m: Column) -> Column:
        def at(gaps: Column) -> Column:
            lengths = F.transform(m, lambda x, i: F.length(x).cast("long") + F.length(F.get(gaps, i)))
            return _let(_scan(lengths, F.lit(0).cast("long"), lambda a, x: a + x), lambda before: placed(m, gaps, before))

        return F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), at)).otherwise(F.array().cast(f"array<{_FOUND}>"))

    return _let(matches, cut)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The check digit is right: every second digit from the end doubled, less 9 above 9, adds up to a multiple of ten."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(F.transform(doubled, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == IP:
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == CARD:
        d = _digits(m)
        return F.length(d).between(12, 19) & passes_luhn(d)
    if kind == PHONE:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _counted(kind: int) -> Column:
    return F.filter(f"__all{kind}", lambda x: _valid(kind, x["m"]))


def _base_as(kind: int, *names: str) -> Column:
    """The base matches of a kind as structs of ``kind`` and some of their fields."""
    return F.transform(f"__base{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in names]))


def _with_base(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``__base0`` .. ``__base3``: the base matches of each kind that count."""
    rows = rows.withColumns({f"__all{k}": _found(F.col(text), _BASE[k], _BASE_NEEDS[k]) for k in range(4)})
    return rows.withColumns({f"__base{k}": _counted(k) for k in range(4)}).drop(
        *[f"__all{k}" for k in range(4)]
    )


_BOUNDARY = (r"[\p{L}_]", r"[0-9]", r"[.@/-]")


def _side(char: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 a sign that joins, 4 another sign."""
    out = F.when(char.rlike(r"^\s?\z"), 0)
    for i, c in enumerate(_BOUNDARY):
        out = out.when(char.rlike(f"^{c}"), i + 1)
    return out.otherwise(4)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _features(kind: Column, x: Column) -> Column:
    """Format and context of a proposal, as array<double>."""
    m, left, right = x["m"], x["l"], x["r"]
    d = _digits(m)
    check = (
        F.when(kind == EMAIL, m.rlike(r"(?i)[a-z]{2,}\z"))
        .when(kind == IP, F.regexp_replace(m, r"[^0-9]+", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"))
        .when(kind == CARD, passes_luhn(d))
        .otherwise(F.length(d).between(9, 15))
    )
    values = [
        kind, F.length(m), F.length(d), _flag(check), F.regexp_count(m, F.lit(r"[\[({]")), F.regexp_count(m, F.lit(r"[\x20.()-]")),
        F.regexp_count(m, F.lit(r"\.")), _side(F.right(left, F.lit(1))), _side(F.left(right, F.lit(1))),
        _flag(left.rlike(r"[0-9][\x20.()-]{0,2}\z")), _flag(right.rlike(r"^[\x20.()-]{0,2}[0-9]")),
        F.coalesce(F.left(d, F.lit(1)).try_cast("int"), F.lit(-1)), F.size(F.array_distinct(F.split(d, ""))),
        _flag(left.rlike(_CUE)), _flag(left.rlike(_COUNTER_CUE)), _flag(m.startswith("+")), _flag(m.rlike(r"(?i)[\x20]at[\x20]")),
        _flag(m.rlike(r"(?i)(?:[\x20]dot[\x20]|[\])}][\x20]?)[a-z]{2,}\z")), F.regexp_count(m, F.lit(r"[A-Z]")),
    ]
    return F.array(*[v.cast("double") for v in values])


def _proposals(text: Column) -> Column:
    """All proposals of all generators: kind, start, end and features."""

    def one(kind: int, needs: str, pattern: str) -> Column:
        number = F.lit(kind)
        return F.transform(
            _found(text, pattern, needs),
            lambda x: F.struct(number.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _features(number, x).alias("f")),
        )

    return F.concat(*[one(*g) for g in _GENERATORS])


def _rewritten(kind: Column, m: Column, left: Column, right: Column) -> Column:
    """Spellings of a base span in its context, as structs of text, label and the left and right context."""
    d = _digits(m)
    number = F.conv(F.substring(F.md5(m), 1, 12), 16, 10)
    ten = F.right(F.concat(F.lit("0000000000"), d), F.lit(10))
    area, middle, line = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    word = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\p{L}+)", 1), F.lit("")), F.lit("noon"))
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def v(text: Column, label: int, before: Column = left, after: Column = right) -> Column:
        return F.struct(text.alias("m"), F.lit(label).alias("label"), before.alias("l"), after.alias("r"))

    def grouped(digits: Column, sep: str) -> Column:
        return F.rtrim(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + sep))

    def spelt(at: str, dot: str) -> Column:
        return F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))

    wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 3) % 10).cast("string"))
    beside = F.concat(F.lit(" "), F.right(F.concat(number, number), F.lit(16)), F.lit(" "))
    digits_before, version, order = F.concat(left, F.lit(" 555-3296 ")), F.concat(left, F.lit(" version ")), F.concat(left, F.lit(" order "))
    emails = [
        v(m, 1), v(spelt(" [at] ", " [dot] "), 1), v(spelt("(at)", "(dot)"), 1), v(spelt(" at ", " dot "), 1), v(spelt(" @ ", "."), 1),
        v(F.concat(word(left), F.lit(" at "), word(right), F.lit("."), F.initcap(word(left))), 0),
        v(F.concat(word(right), F.lit(" at "), word(left), F.lit("."), word(right)), 0),
    ]
    ips = [
        v(m, 1), v(F.replace(m, F.lit("."), F.lit("[.]")), 1), v(F.replace(m, F.lit("."), F.lit("(dot)")), 1),
        v(F.concat(F.lit("3"), F.lpad(m, F.length(m) + 1, "9")), 0), v(F.regexp_replace(m, r"[0-9]+$", "999"), 0),
        v(m, 0, version), v(m, 0, left, F.lit(".7 ")), v(F.replace(m, F.lit("."), F.lit("[.]")), 0, version),
    ]
    cards = [
        v(d, 1), v(grouped(d, " "), 1), v(grouped(d, "-"), 1), v(grouped(d, "."), 1), v(d, 1, digits_before), v(d, 1, left, F.lit(" +1 (555) 201-3344 ")),
        v(wrong, 0), v(grouped(wrong, "."), 0), v(grouped(wrong, " "), 0), v(wrong, 0, digits_before), v(grouped(d, "."), 0, order),
    ]
    us = F.concat(F.lit("("), area, F.lit(") "), middle, F.lit("-"), line)
    phones = [
        v(m, 1), v(m, 1, left, beside), v(us, 1), v(us, 1, left, beside), v(F.concat_ws("-", area, middle, line), 1), v(F.concat_ws(".", area, middle, line), 1),
        v(F.concat_ws("-", area, middle, line), 0, order), v(F.concat_ws("-", area, middle, line), 0, left, F.concat(F.lit("-"), line)),
        v(F.concat_ws("-", area, middle, line), 0, F.concat(left, F.lit(" AB-"))), v(F.concat_ws(" ", area, middle, line), 0, F.concat(left, F.lit(" 12 "))),
    ]
    return F.when(kind == EMAIL, F.array(*emails)).when(kind == IP, F.array(*ips)).when(kind == CARD, F.array(*cards)).otherwise(F.array(*phones))


def training_proposals(docs: DataFrame, text: str = "text", spans: int | None = None) -> DataFrame:
    """``(kind, f, label, held_out)``: proposals on the rewritten base spans of ``docs``, all different ones.

    With ``spans``, at most about so many of each kind take part (those with the smallest hashes). A quarter, by hash of
    the span, is held out for the thresholds. NULL and empty texts have no spans.
    """
    rows = _with_base(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")), "__text")
    found = rows.select(F.explode(F.concat(*[_base_as(k, "m", "l", "r") for k in range(4)])).alias("s")).select("s.*").distinct()
    # Spans are short and what is done with each is long: they are dealt over all tasks, however few bytes they are.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "kind", "m", "l", "r")
    if spans is not None:
        found = cut_lineage(found.withColumn("h", F.xxhash64("kind", "m", "l", "r") / F.lit(2.0**64) + 0.5))
        share = {r.kind: spans / r.n for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = found.where(reduce(lambda c, k: c | ((F.col("kind") == k) & (F.col("h") < share[k])), share, F.lit(False)))
    sample = found.select("kind", "m", F.explode(_rewritten(F.col("kind"), F.col("m"), F.col("l"), F.col("r"))).alias("v"))
    sample = sample.select(
        "kind", (F.pmod(F.crc32("m"), F.lit(4)) == 3).alias("held_out"), "v.label", F.concat("v.l", "v.m", "v.r").alias("__text"),
        F.length("v.l").alias("lo"), (F.length("v.l") + F.length("v.m")).alias("hi"),
    )
    proposed = sample.select("*", F.explode(_proposals(F.col("__text"))).alias("p"))
    same = (F.col("p.kind") == F.col("kind")) & (F.col("p.start") == F.col("lo")) & (F.col("p.end") == F.col("hi"))
    touches = (F.col("p.start") < F.col("hi")) & (F.col("p.end") > F.col("lo"))
    label = F.when(same, F.col("label")).otherwise(0).cast("double")
    return proposed.where(touches).select(F.col("p.kind").alias("kind"), F.col("p.f").alias("f"), label.alias("label"), "held_out")


@dataclass
class Model:
    """Boosted trees as nested tuples (feature, threshold, at most, above) or a leaf's value, their weights, and the
    score from which proposals of a kind are selected (kinds that are missing add nothing)."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, f: Column) -> Column:
        """The probability that a proposal is personal data, from its features."""

        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, low, high = node
            return F.when(F.get(f, F.lit(feature)) <= threshold, value(low)).otherwise(value(high))

        margin = reduce(lambda a, b: a + b, [value(t) * w for t, w in zip(self.trees, self.weights, strict=True)], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, kind: Column, score: Column) -> Column:
        return reduce(lambda c, k: c | ((kind == k) & (score >= self.thresholds[k])), self.thresholds, F.lit(False))


def _tree(node) -> tuple | float:
    """A node of Spark ML's tree as nested tuples."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit_model(docs: DataFrame, text: str = "text", spans: int | None = None, precision: float = PRECISION) -> Model:
    """Boosted trees fitted on :func:`training_proposals`, with a threshold per kind: the lowest score from which on
    held-out proposals of that kind reach ``precision``. A kind without such a score adds nothing; without both labels
    in the fitted part there are no trees."""
    alike = training_proposals(docs, text, spans).groupBy("kind", "f", "label", "held_out")
    rows = cut_lineage(alike.agg(F.count(F.lit(1)).cast("double").alias("n")))
    fitted = rows.where(~F.col("held_out")).select(array_to_vector("f").alias("features"), "label", "n")
    if len(fitted.select("label").distinct().collect()) < 2:
        return Model()
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=64, weightCol="n").fit(fitted)
    model = Model([_tree(t._java_obj.rootNode()) for t in gbt.trees], list(gbt.treeWeights))
    counts = rows.where("held_out").withColumn("s", model.score(F.col("f"))).groupBy("kind", "s").agg(F.sum(F.col("label") * F.col("n")).alias("y"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.col("s").desc())
    reached = counts.withColumn("p", F.sum("y").over(down) / F.sum("n").over(down)).where(F.col("p") >= precision)
    model.thresholds = {r.kind: r.s for r in reached.groupBy("kind").agg(F.min("s").alias("s")).collect()}
    return model


def _best(proposals: Column) -> Column:
    """Of proposals that overlap, the one with the best score (then the earlier, then the longer), from left to right."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        better = (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (x["start"] == last["start"]) & (x["end"] > last["end"]))
        without_last = F.slice(kept, F.lit(1), F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (x["start"] >= F.coalesce(last["end"], F.lit(0))), F.concat(kept, F.array(x)))
            .when(better, F.concat(without_last, F.array(x)))
            .otherwise(kept)
        )

    def by_cluster(ordered: Column) -> Column:
        """Runs that no later proposal reaches into are settled on their own."""

        def runs(reach: Column) -> Column:
            first = F.filter(F.transform(ordered, lambda x, i: F.when(x["start"] >= F.get(reach, i), i)), lambda i: i.isNotNull())
            return _let(F.concat(first, F.array(F.size(ordered))), lambda seams: F.flatten(F.transform(
                F.slice(seams, F.lit(1), F.size(seams) - 1),
                lambda lo, j: F.aggregate(F.slice(ordered, lo + 1, F.get(seams, j + 1) - lo), F.array().cast(_SPAN), step),
            )))

        return _let(_scan(F.transform(ordered, lambda x: x["end"]), F.lit(0).cast("long"), _larger), runs)

    return _let(F.array_sort(proposals), by_cluster)


def _beside_base(proposals: Column, base: Column) -> Column:
    """The proposals that overlap no base span."""
    last = F.lit(2**62)

    def free(ordered: Column) -> Column:
        is_base = lambda x: x["score"] > 1
        ends = F.transform(ordered, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0).cast("long")))
        starts = F.transform(F.reverse(ordered), lambda x: F.when(is_base(x), x["start"]).otherwise(last))
        return _let(_scan(ends, F.lit(0).cast("long"), _larger), lambda reach: _let(
            F.reverse(_scan(starts, last, _smaller)),
            lambda onward: F.filter(ordered, lambda x, i: ~is_base(x) & (F.get(reach, i) <= x["start"]) & (F.get(onward, i) >= x["end"])),
        ))

    marked = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(2.0).alias("score")))
    return _let(F.array_sort(F.concat(marked, proposals)), free)


def find_personal_data(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: array<struct<start, kind, end, score>> by start, then kind.

    Positions are code points of the text, end exclusive; kinds are places in KINDS; base spans have score 1.0.
    ``spans`` are the base spans and, of the proposals that overlap none of them, those that the model (fitted on
    ``docs`` if not given) selects.

    NULL text: as empty, no spans. Every row is a record of its own, whatever its ids or repeats. Input columns named
    ``base_spans`` or ``spans`` are replaced; others pass through. Empty tables give an empty result.
    """
    model = fit_model(docs, text) if model is None else model
    rows = _with_base(docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))), "__text")
    base = F.transform(
        F.concat(*[_base_as(k, "start", "end") for k in range(4)]),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(1.0).alias("score")),
    )
    rows = rows.withColumn("base_spans", F.array_sort(base)).drop(*[f"__base{k}" for k in range(4)])
    if not model.thresholds:
        return rows.withColumn("spans", F.col("base_spans")).drop("__text")
    scored = F.transform(
        _proposals(F.col("__text")),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), model.score(x["f"]).alias("score")),
    )
    rows = rows.withColumn("__new", scored)
    rows = rows.withColumn("__new", F.filter("__new", lambda x: model.selects(x["kind"], x["score"])))
    free = _best(_beside_base(F.col("__new"), F.col("base_spans")))
    rows = rows.withColumn("__new", F.when(F.size("__new") == 0, F.col("__new")).otherwise(free))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", "__new"))).drop("__new", "__text")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def span_digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row, from :func:`find_personal_data`.

    The counts and the hash are of the base spans; ``n_added`` counts those that the model adds.
    """
    found = find_personal_data(docs.select("doc_id", "text"), model)

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    added = (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets (``<email>``); what overlaps a span
    that starts earlier goes with it. NULL texts stay NULL. Columns and rows are those of ``docs``."""
    found = find_personal_data(docs, model, text)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    before = _scan(F.transform("spans", lambda x: x["end"]), F.lit(0).cast("long"), _larger)
    parts = F.transform(F.arrays_zip("spans", before.alias("before")), lambda z: F.when(
        z["spans"]["start"] >= z["before"],
        F.concat(F.substring(F.col(text), z["before"].cast("int") + 1, (z["spans"]["start"] - z["before"]).cast("int")), F.get(names, z["spans"]["kind"])),
    ).otherwise(""))
    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0).cast("long")).cast("int")
    rest = F.substring(F.col(text), last + 1, F.length(text))
    return found.withColumn(text, F.concat(F.array_join(parts, ""), rest)).select(*docs.columns)
