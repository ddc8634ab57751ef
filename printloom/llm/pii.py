"""Personal data: base expressions, and bootstrapped contextual extraction, in DataFrame functions only.

Base matches are seeds. The words around them make lexical patterns; around other candidates they make the same
patterns: tokens with digits, runs of digit groups with spaces or brackets between them, and addresses spelt out with
"at" and "dot". The graph of patterns and instances is scored until nothing new is found: a pattern's score for a kind
is the share of its distinct instances that the kind has accepted; an instance's is the chance that not all its
patterns err. What confident patterns discover is accepted for the next round, and its spans are added to the base
spans, which all stay. A value that is a seed or found in one place is marked wherever it stands apart from base spans.

Cases: a null text is an empty one; whole texts are searched, however many matches they hold (places are running sums
in two levels, so a text of n matches takes n to the power 1.5 steps); repeated rows give repeated results; ids may
repeat or be null (rows are matched by id and text); ties of an instance's kinds go to the kind listed first; an empty
table gives an empty one; other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats and looks behind keep the leftmost, non-overlapping matches of the base expressions and spare retries.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be an identifier: a token with a digit in it, a short run of digit groups, an address spelt out.
CANDIDATES = (
    r"(?<![A-Za-z0-9._@+-])[A-Za-z._@+-]*+[0-9][A-Za-z0-9._@+-]*+",
    r"(?<![A-Za-z0-9._@+-])(?:\+|\()?+[0-9]++(?:[\x20().-]{1,3}+[0-9]++){1,7}+(?![A-Za-z0-9_@])",
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20at\x20|\x20?\(at\)\x20?|\x20?\[at\]\x20?)[a-z0-9-]++(?:(?:\x20dot\x20|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[a-z0-9-]++){1,4}+",
)
#: Least characters of a candidate.
MIN_TOKEN = 4
#: Distinct accepted instances and score that make a pattern confident; an instance's least score; trust in a pattern.
MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE, TRUST = 3, 0.5, 0.7, 0.9

SPAN = "struct<start:int,kind:int,end:int,value:string,left:string,right:string>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Do the digits of x pass: from the right, each second one doubled, less 9 above 9, in all a multiple of 10?"""
    d = F.reverse(digits(x))

    def part(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def part_fits(x: Column) -> Column:
    """Is the decimal number at most 255, whatever its leading zeros?"""
    short = F.regexp_replace(x, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), part_fits)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def bound(x: Column, use) -> Column:
    """``use`` of the value of x, which is computed once however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def running(values: Column, op, zero: int) -> Column:
    """``op`` of each whole number and all before it: in blocks as long as there are blocks, then over the blocks."""
    none = F.array().cast("array<int>")

    def whole(v: Column) -> Column:
        n = F.size(v)
        side = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        start = F.struct(F.lit(zero).alias("at"), none.alias("all"))

        def block(j: Column) -> Column:
            step = lambda s, x: bound(op(s["at"], x), lambda y: F.struct(y.alias("at"), F.concat(s["all"], F.array(y)).alias("all")))
            return F.aggregate(F.slice(v, j * side + 1, side), start, step)

        def joined(blocks: Column) -> Column:
            before = F.aggregate(blocks, start, lambda s, b: F.struct(op(s["at"], b["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
            return bound(before, lambda c: F.flatten(F.transform(blocks, lambda b, j: F.transform(b["all"], lambda y: op(F.get(c, j), y)))))

        return F.when(n > 0, bound(F.transform(F.sequence(F.lit(0), F.ceil(n / side).cast("int") - 1), block), joined)).otherwise(none)

    return bound(values, whole)


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs of place, kind, value and the words next to them, in order.

    The text split at the matches has one piece more than there are matches; running sums of lengths give the places.
    """

    def spans(s: Column) -> Column:
        found, pieces = s["found"], s["pieces"]
        lengths = F.transform(found, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))

        def placed(ends: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                left, right = F.substring_index(F.rtrim(F.get(pieces, i)), " ", -4), F.substring_index(F.ltrim(F.get(pieces, i + 1)), " ", 2)
                return F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), v.alias("value"), left.alias("left"), right.alias("right"))

            return F.transform(found, span)

        return bound(running(lengths, lambda a, b: a + b, 0), placed)

    return bound(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)


def base_spans(text: Column) -> Column:
    """Valid matches of all base kinds, by start, then kind. Texts without a kind's sign skip its expression."""
    empty = F.array().cast(f"array<{SPAN}>")
    signs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}

    def matches(i: int, kind: str) -> Column:
        return F.when(signs[kind], F.filter(located(text, PATTERNS[kind], i), lambda s: valid(kind, s["value"]))).otherwise(empty)

    return F.array_sort(F.concat(*(matches(i, kind) for i, kind in enumerate(KINDS))))


def other_tokens(text: Column) -> Column:
    """Candidates without closing punctuation, by start."""
    empty = F.array().cast(f"array<{SPAN}>")

    def trimmed(s: Column) -> Column:
        value = F.regexp_replace(s["value"], r"[._@+-]+$", "")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] + F.length(value)).alias("end"), value.alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    signs = (text.rlike("[0-9]"), text.rlike(r"[0-9][\x20().-]{1,3}[0-9]"), text.rlike(r"(?i)(?:\x20|\(|\[)dot(?:\x20|\)|\])"))
    found = [F.when(sign, F.transform(located(text, expression, -1), trimmed)).otherwise(empty) for sign, expression in zip(signs, CANDIDATES)]
    return F.filter(F.concat(*found), lambda s: F.length(s["value"]) >= MIN_TOKEN)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: none that starts before ends later, none that starts later starts within."""
    last = (1 << 31) - 1

    def kept(t: Column) -> Column:
        of_base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("of"), s["end"].alias("end")))
        of_tokens = F.transform(t, lambda s, i: F.struct(s["start"].alias("start"), i.alias("of"), s["end"].alias("end")))

        def tested(marks: Column) -> Column:
            before = running(F.transform(marks, lambda m: F.when(m["of"] < 0, m["end"]).otherwise(0)), F.greatest, 0)
            after = F.reverse(running(F.reverse(F.transform(marks, lambda m: F.when(m["of"] < 0, m["start"]).otherwise(last))), F.least, last))
            both = F.struct(before.alias("before"), after.alias("after"))
            free = lambda e: F.filter(marks, lambda m, i: (m["of"] >= 0) & (F.get(e["before"], i) <= m["start"]) & (F.get(e["after"], i) >= m["end"]))
            return F.transform(bound(both, free), lambda m: F.get(t, m["of"]))

        return bound(F.array_sort(F.concat(of_base, of_tokens)), tested)

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(bound(tokens, kept))


def patterns(s: Column) -> Column:
    """Lexical patterns of a span: the two words before it, and the words on either side; digits in them are alike."""
    clean = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#")
    left, right = F.split(F.trim(F.regexp_replace(clean(s["left"]), r"\s+", " ")), " "), F.split(F.trim(F.regexp_replace(clean(s["right"]), r"\s+", " ")), " ")
    last, before, after = F.element_at(left, -1), F.try_element_at(left, F.lit(-2)), F.element_at(right, 1)
    two = F.when(F.length(last) > 0, F.concat(F.lit("L:"), before, F.lit(" "), last))
    both = F.when((F.length(last) > 0) & (F.length(after) > 0), F.concat(F.lit("B:"), last, F.lit(" _ "), after))
    return F.filter(F.array(two, both), lambda p: p.isNotNull())


def notation(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def bootstrap(seeds: DataFrame, tokens: DataFrame) -> DataFrame:
    """value, kind and trust of what confident patterns discover. seeds: kind, value, pattern; tokens: value, pattern.

    A round accepts what the patterns of all that was accepted before make likely enough; what is accepted stays so,
    with its kind, and the rounds end when one finds nothing.
    """
    edges = written(seeds.select("pattern", "value").union(tokens.select("pattern", "value")).distinct())
    open_edges = written(tokens.select("pattern", "value").distinct().join(seeds.select("value").distinct(), "value", "left_anti"))
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    known = written(seeds.select("kind", "value").distinct().withColumn("trust", F.lit(1.0)))
    found = known.where("false")
    while True:
        support = edges.join(known.union(found), "value").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("trust").alias("weight")).where(F.col("support") >= MIN_SUPPORT)
        confident = support.join(sizes, "pattern").withColumn("score", F.least(F.lit(1.0), F.col("weight") / F.col("n"))).where(F.col("score") >= MIN_PATTERN)
        chance = 1 - F.exp(F.sum(F.log(1 - TRUST * F.col("score"))))
        open_now = open_edges.join(found.select("value"), "value", "left_anti")
        per = open_now.join(confident.select("pattern", "kind", "score"), "pattern").groupBy("value", "kind").agg(chance.alias("trust")).where(F.col("trust") >= MIN_INSTANCE)
        best = F.max(F.struct("trust", (-F.col("kind")).alias("order"))).alias("best")
        new = written(per.groupBy("value").agg(best).select((-F.col("best.order")).alias("kind"), "value", F.col("best.trust").alias("trust")))
        if new.isEmpty():
            return found
        found = found.union(new)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of the base kinds, digest of the base spans, all spans, and how many were discovered."""
    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("h"), base_spans(t).alias("base"), other_tokens(t).alias("tokens"))
    own = written(read.select("k", "h", "base", apart(F.col("tokens"), F.col("base")).alias("tokens")))

    spans = own.where(F.size("base") > 0).select(F.explode("base").alias("s"))
    seeds_of = spans.select("s.kind", "s.value")
    seeds = spans.select("s.kind", "s.value", F.explode(patterns(F.col("s"))).alias("pattern"))
    tokens = own.where(F.size("tokens") > 0).select("k", "h", F.explode("tokens").alias("s"))
    found = bootstrap(seeds, tokens.select("s.value", F.explode(patterns(F.col("s"))).alias("pattern")))
    # a value accepted in one place is marked in all; a seed's kind is that of its base match
    known = seeds_of.groupBy("value").agg(F.min("kind").alias("kind")).union(found.select("value", "kind"))
    hits = tokens.select("k", "h", "s.start", "s.end", "s.value").join(known, "value")
    added = hits.groupBy("k", "h").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")).select(F.col("k").alias("k2"), F.col("h").alias("h2"), "more")
    joined = own.join(added, own.k.eqNullSafe(F.col("k2")) & (own.h == F.col("h2")), "left")

    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return joined.select(F.col("k").alias(key), *map(count, range(len(KINDS))), F.sha2(notation(F.col("base")).cast("binary"), 256).alias("base_sha256"), notation(F.array_sort(F.concat(bare, more))).alias("spans"), F.size(more).cast("long").alias("n_discovered"))
