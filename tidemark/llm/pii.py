"""Personal data by weak supervision, in DataFrame operations only.

Base spans are four patterns; they always stand.  Wider candidate patterns (spelled-out addresses, local phone numbers,
long digit groups) get votes of three kinds of labelers, patterns, gazetteers and context words, as do the base spans.
Votes are pre-aggregated to counts by (kind, vote pattern), a table bounded by the number of patterns (at most 108 rows);
expectation-maximisation over it estimates how reliable each labeler is.  Its posteriors weight the training of the final
span classifier, a naive Bayes model over bounded span features, and a candidate is added where the classifier's log odds
pass the threshold and it overlaps no base span.

Gazetteers are lists, not patterns: top-level and mail provider domains, issuer ranges of cards, country and area codes,
special-purpose address blocks; a value is looked up by its last label or its leading digits.

Positions: each pattern marks its matches in one pass with a control character that no pattern can match; splitting there
gives the text between matches and the matches in turn, and running lengths give offsets in code points.  Running sums,
and the running ends that tell which candidates meet a base span, are made block by block, so a text with very many
matches costs little more than its length.  The patterns
start at the left edge of a run or where the last match ended, which is where a leftmost match must start, and repeat
possessively, so long runs cost linear time and no stack.

The texts are read once and never shuffled; what is written and grouped are spans.

Defined results: null or empty text has no span; repeated rows and null ids get a row each; an empty table gives no rows;
extra columns are ignored; without candidates the model is never consulted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\u0001", "\u0002"

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Za-z:.\])])(?:[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z-])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-]*[0-9A-Za-z])",
}
#: Context words before a span, by kind.
CUES = {
    "email": "mail|contact|correo|courriel|write to|kontakt|contacto",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": r"card|visa|master|amex|karte|tarjeta|carte\b|credit|kredit",
    "phone": r"\btel|phone|call|mobile|fax|telefon|tel.fono|t.l.phone|handy|m.vil",
}
#: Top-level domains and mail provider names, leading digits of card issuers, of telephone country codes and
#: of special-purpose addresses.
DOMAINS = "com org net edu gov mil int info biz name io dev app co me tv ai de at ch fr es it pt nl be lu dk se no fi is ie uk eu pl cz sk hu ro bg gr tr ru ua us ca mx br ar cl pe jp cn kr in au nz za".split()
PROVIDERS = "gmail yahoo hotmail outlook live icloud aol gmx web mail protonmail yandex fastmail zoho orange wanadoo libero terra t-online freenet example".split()
ISSUERS = ["4", "34", "37", "36", "38", "39", "300", "301", "302", "303", "304", "305", "51", "52", "53", "54", "55", "62", "6011", "64", "65", "3528", "3530", "3566", "3589", "50", "56", "57", "58", "67", "2221", "2300", "2500", "2720"]
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 971 972".split()
SPECIAL = "0 10 127 169.254 192.168 192.0.2 198.51.100 203.0.113 100.64 255".split()


def starts_with_any(value: Column, entries: list[str]) -> Column:
    """Whether one of the entries is at the head of value: a look-up of its heads of the entries' lengths."""
    lengths = sorted({len(e) for e in entries})
    return F.exists(F.array(*[F.left(value, F.lit(n)) for n in lengths]), lambda head: head.isin(*entries))


def known(kind: str, value: Column) -> Column:
    """The gazetteer's vote on a value: a listed entry speaks for it, a card or telephone number without one against it."""
    if kind == "email":
        labels = F.split(F.regexp_replace(F.regexp_replace(F.lower(value), r"\x20?[(\[{]at[)\]}]\x20?", "@"), r"\x20?[(\[{]dot[)\]}]\x20?", "."), r"[@.]")
        return F.when(F.element_at(labels, -1).isin(*DOMAINS) | F.exists(labels, lambda x: x.isin(*PROVIDERS)), "+").otherwise("-")
    if kind == "card":
        return F.when(starts_with_any(digits(value), ISSUERS), "+").otherwise("-")
    if kind == "phone":
        number = digits(value)
        area = F.regexp_like(value, F.lit(r"^\(?0?[2-9][0-9]{1,2}\)?[\x20.-]"))
        return F.when(F.when(value.startswith("+"), starts_with_any(number, COUNTRIES)).otherwise(area), "+").otherwise("-")
    dotted = F.regexp_replace(value, r"\x20?[\[(](?:dot|\.)[\])]\x20?", ".")
    listed_block = F.exists(F.array(*[F.concat(F.substring_index(dotted, ".", n), F.lit("")) for n in (1, 2, 3)]), lambda head: head.isin(*SPECIAL))
    return F.when(listed_block | F.contains(value, F.lit(":")), "+").otherwise("0")


AROUND = 40
SPAN = "array<struct<kind: string, start: bigint, end: bigint, value: string, base: boolean, votes: string, features: array<string>>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    places = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        number = digits(value)
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def marked(text: Column, pattern: str) -> Column:
    """Text between matches and matches in turn: an array whose odd places are the matches."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1)


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once, as an argument of a lambda is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, step, zero: Column, block: int = 256) -> Column:
    """For each place of an array of numbers the fold of all up to it, in blocks whose folds are then carried over."""

    def folds(part: Column) -> Column:
        start = F.struct(zero.alias("last"), F.array().cast("array<bigint>").alias("out"))

        def grow(acc: Column, x: Column) -> Column:
            now = step(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(part, start, grow)["out"]

    def carried(local: Column) -> Column:
        before = folds(F.transform(local, lambda b: F.element_at(b, -1)))
        return once(before, lambda c: F.flatten(F.transform(local, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: step(F.get(c, k - 1), x))))))

    def blocks(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: F.slice(x, k * block + 1, F.lit(block)))
        return once(F.transform(cut, folds), carried)

    return once(numbers, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(x))


def placed(parts: Column) -> Column:
    """start, end, value and the text just before of each match, from the array of marked()."""

    def spans(x: Column) -> Column:
        ends = running(F.transform(x, lambda p: F.length(p).cast("long")), lambda a, b: a + b, F.lit(0).cast("long"))

        def span(e: Column, j: Column) -> Column:
            before = F.lower(F.right(F.get(x, 2 * j), F.lit(AROUND)))
            return F.struct(F.get(e, 2 * j).alias("start"), F.get(e, 2 * j + 1).alias("end"), F.get(x, 2 * j + 1).alias("value"), before.alias("before"))

        return once(ends, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int") - 1), lambda j: span(e, j)))

    return once(parts, spans)


def voted(kind: str, base: bool, spans: Column) -> Column:
    """Spans with the votes of the pattern, gazetteer and context labelers (+, - or 0 each) and the classifier's features."""

    def vote(s: Column) -> Column:
        value, number = s["value"], digits(s["value"])
        strict = F.when(passes(kind, value), "+").otherwise("-") if base or kind == "card" else F.lit("0")
        listed_as = known(kind, value)
        cue = F.when(s["before"].rlike(CUES[kind]), "+").otherwise("0")
        features = F.array(
            F.concat(F.lit("length "), F.least(F.length(value), F.lit(40)).cast("string")),
            F.concat(F.lit("digits "), F.least(F.length(number), F.lit(20)).cast("string")),
            F.concat(F.lit("shape "), F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]+", "."), 1, 8)),
            F.concat(F.lit("cue "), cue),
            F.concat(F.lit("known "), listed_as),
            F.concat(F.lit("strict "), strict),
        )
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"),
            F.lit(base).alias("base"), F.concat(strict, listed_as, cue).alias("votes"), features.alias("features"),
        )

    return F.transform(spans, vote)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and wider candidates of every row, from one read of the texts."""
    none = F.array().cast(SPAN)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.col("text").rlike("[0-9]").alias("digit"))
    gate = {"email": F.contains("text", F.lit("@")), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.contains("text", F.lit("+"))}
    wide_gate = {"email": F.col("text").rlike(r"[(\[{]at[)\]}]"), "ip": F.col("digit") & F.col("text").rlike(r"[\[(](?:dot|\.)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": F.col("digit"), "phone": F.col("digit")}
    base_parts = [F.when(gate[k], marked(F.col("text"), BASE[k])).alias(f"b_{k}") for k in KINDS]
    wide_parts = [F.when(wide_gate[k], marked(F.col("text"), WIDE[k])).alias(f"w_{k}") for k in WIDE]
    parts = texts.select("doc_id", *base_parts, *wide_parts)

    def spans(kind: str, base: bool) -> Column:
        name = f"{'b' if base else 'w'}_{kind}"
        many = F.size(name) > 1
        if not base:
            return F.when(many, voted(kind, False, placed(F.col(name)))).otherwise(none)
        return F.when(many, voted(kind, True, F.filter(placed(F.col(name)), lambda s: passes(kind, s["value"])))).otherwise(none)

    return parts.select("doc_id", F.concat(*[spans(k, True) for k in KINDS]).alias("base"), F.concat(*[spans(k, False) for k in WIDE]).alias("wide"))


def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Expectation-maximisation over counts of (kind, votes): the posterior of each vote pattern.

    Starts from the majority of the votes; each labeler has, for either class, smoothed chances of +, - and 0.
    """
    post = {(k, v): 0.9 if v.count("+") > v.count("-") else 0.1 if v.count("+") < v.count("-") else 0.5 for k, v, _ in counts}
    if not counts:
        return post
    width = len(counts[0][1])
    for _ in range(rounds):
        weight = [sum(n * (post[k, v] if c else 1 - post[k, v]) for k, v, n in counts) + 1 for c in (0, 1)]
        chance = [
            [{s: (sum(n * (post[k, v] if c else 1 - post[k, v]) for k, v, n in counts if v[j] == s) + 1) / (weight[c] + 2) for s in "+-0"} for j in range(width)]
            for c in (0, 1)
        ]
        for k, v, _ in counts:
            log = [math.log(weight[c]) + sum(math.log(chance[c][j][s]) for j, s in enumerate(v)) for c in (0, 1)]
            post[k, v] = 1 / (1 + math.exp(min(50.0, max(-50.0, log[0] - log[1]))))
    return post


def literal_map(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))


def classifier(spans: DataFrame, post: dict[tuple[str, str], float]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of each (kind, feature) and prior log-odds by kind, trained on spans weighted by their posteriors."""
    weight = F.element_at(literal_map({f"{k} {v}": p for (k, v), p in post.items()}), F.concat_ws(" ", "kind", "votes"))
    rated = spans.select("kind", "features", weight.alias("p"))
    prior = {r["kind"]: (r["p"], r["n"]) for r in rated.groupBy("kind").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()}
    each = rated.select("kind", F.explode("features").alias("f"), "p").groupBy("kind", "f").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    odds = {}
    for r in each.collect():  # bounded: shapes are 8 of three signs, the others are few or have a ceiling
        yes, all_ = prior[r["kind"]]
        odds[f"{r['kind']} {r['f']}"] = math.log((r["p"] + 0.5) / (yes + 1)) - math.log((r["n"] - r["p"] + 0.5) / (all_ - yes + 1))
    return odds, {k: math.log((p + 1) / (n - p + 1)) for k, (p, n) in prior.items()}


def find(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """doc_id, base spans and all spans (kind, start, end, value) of every row, in order of start and kind."""
    rows = materialize(candidates(docs), "pii")
    spans = rows.where("size(base) + size(wide) > 0").select(F.explode(F.concat("base", "wide")).alias("s")).select("s.*")
    counts = [(r["kind"], r["votes"], r["n"]) for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    odds, prior = classifier(spans, reliabilities(counts))
    table, priors = literal_map(odds), literal_map(prior)

    def score(s: Column) -> Column:
        return F.aggregate(
            s["features"], F.coalesce(F.element_at(priors, s["kind"]), F.lit(0.0)), lambda a, f: a + F.coalesce(F.element_at(table, F.concat_ws(" ", s["kind"], f)), F.lit(0.0))
        )

    def clear(spans: Column) -> Column:
        """Those of the spans, ordered by start, that are candidates, score over the threshold and meet no base span.

        A candidate meets an earlier base span if the furthest end so far lies behind its start, and a later one if the
        nearest start from the back lies before its end.
        """

        def picked(x: Column) -> Column:
            n = F.size(x)
            far = running(F.transform(x, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, F.lit(-1).cast("long"))
            last = F.lit(1 << 62)
            near = running(F.transform(F.reverse(x), lambda s: F.when(s["base"], s["start"]).otherwise(last)), F.least, last)
            both = F.struct(far.alias("far"), near.alias("near"))
            marked_spans = once(both, lambda m: F.transform(x, lambda s, i: F.struct(s.alias("s"), (~s["base"] & (F.get(m["far"], i) <= s["start"]) & (F.get(m["near"], n - 1 - i) >= s["end"])).alias("clear"))))
            return F.transform(F.filter(marked_spans, lambda t: t["clear"] & (score(t["s"]) > threshold)), lambda t: t["s"])

        return once(F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), picked)

    def ordered(spans: Column) -> Column:
        order = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    extra = F.when(F.size("wide") > 0, clear(F.concat("base", "wide"))).otherwise(F.array().cast(SPAN))
    return rows.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat(F.col("base"), extra)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
