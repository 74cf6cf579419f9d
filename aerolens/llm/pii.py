"""Operator 9: personal data in texts.

Regular expressions propose spans, checks confirm them (number ranges, digit
counts, Luhn for cards, mod-97 for IBANs), and words near a span raise its
score. The four base kinds are reported whenever their check holds; the added
kinds (IBANs, shorter card numbers, phone numbers without a country code) only
from a score of ``THRESHOLD`` on. Everything is Column expressions.

Spans of one kind are leftmost and do not overlap; a proposal whose check fails
is dropped without another try. Offsets are code points, the end exclusive.

Defined results: a null or empty text has no spans and masks to itself; spans
of different kinds may overlap; repeated rows are treated one by one. The
patterns use possessive quantifiers and start only where a run starts, so very
long runs of one character class stay linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

THRESHOLD = 0.5
CONTEXT_BONUS = 0.4
BEFORE, AFTER = 40, 24

#: IBAN lengths by country (public registry), without the two letters and two check digits.
IBAN_LENGTHS = {11: "NO", 12: "BE", 14: "DK FI NL", 15: "MK SI", 16: "AT BA EE KZ LT LU", 17: "CH HR LI LV",
                18: "BG BH CR DE GB GE IE ME RS", 19: "AE IL", 20: "AD CZ ES PK RO SA SE SK TN VG", 21: "PT",
                22: "IS TR", 23: "FR GR IT MC SM", 24: "AL AZ CY DO HU LB PL", 25: "BR PS QA", 27: "MT"}
IBAN = "|".join(f"(?:{'|'.join(cs.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, cs in IBAN_LENGTHS.items())
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    #: For Java: linear on long runs. ``plain`` matches the same spans and is what SQL engines take.
    pattern: str
    plain: str
    check: str
    digits: tuple[int, int]
    score: float
    context: str
    base: bool


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "none", (0, 0), 0.9, "mail|contact|write", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "octets", (0, 0), 0.6, "ip|host|server|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", "luhn", (16, 19), 0.7,
         "card|visa|credit|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "digits", (8, 15), 0.7,
         "phone|tel|call|fax|mobile", True),
    Kind("iban", IBAN, IBAN, "mod97", (0, 0), 0.9, "iban|account|bank|konto|cuenta|compte", False),
    Kind("card_short", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", "luhn", (13, 15), 0.3,
         "card|visa|credit|karte|carte|tarjeta", False),
    Kind("phone_local", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
         "digits", (10, 10), 0.3, "phone|tel|call|fax|mobile", False),
)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Do the digits of ``v`` pass the Luhn check?"""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(_digits(v)), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(v: Column) -> Column:
    """Does the account number ``v`` leave 1 modulo 97 (ISO 13616)?"""
    moved = let(F.regexp_replace(v, " ", ""), lambda s: F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4)))
    number = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.split(number, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + c.cast("int")) % 97)) == 1


def _holds(kind: Kind, v: Column) -> Column:
    count = F.length(_digits(v)).between(*kind.digits)
    return {"none": F.lit(True), "octets": v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "digits": count,
            "luhn": count & luhn(v), "mod97": mod97(v)}[kind.check]


def _before(sizes: Column, block: int = 256) -> Column:
    """Running sums of an int array, each without its own element. In blocks, as every
    step of a running sum copies the array that it grows."""
    def scan(xs: Column, start: Column) -> Column:
        full = F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(full, 1, F.size(xs))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")),
                        lambda b: F.slice(sizes, b * block + 1, block))
    whole = let(parts, lambda ps: F.flatten(F.zip_with(ps, scan(F.transform(ps, total), F.lit(0)), scan)))
    return F.when(F.size(sizes) > 0, whole).otherwise(F.array().cast("array<int>"))


def _last(text: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return text.substr(F.lit(-n), F.lit(n))


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score)."""
    def build(m: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda p: place(m, p))

    def place(m: Column, p: Column) -> Column:
        lead = F.transform(m, lambda v, i: F.length(p[i]) + F.length(v))
        # The ends of what stands before each proposal's end, and the beginnings from each proposal's end on: a proposal has
        # two characters or more, so so many neighbours hold all that a window can show, wherever other proposals stand.
        backs = F.transform(m, lambda v, i: _last(F.concat(p[i], v), BEFORE))
        fronts = F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(m, i), F.lit(""))).substr(1, AFTER))

        def window(i: Column, backs: Column, fronts: Column) -> Column:
            first = F.greatest(i - BEFORE // 2, F.lit(0))
            before = _last(F.concat(F.array_join(F.slice(backs, first + 1, i - first), ""), p[i]), BEFORE)
            return F.lower(F.concat(before, F.lit(" "), F.array_join(F.slice(fronts, i + 2, F.lit(AFTER // 2 + 1)), "").substr(1, AFTER)))
        return let(backs, lambda bs: let(fronts, lambda fs: let(_before(lead), lambda at: F.transform(
            m, lambda v, i: one(v, at[i] + F.length(p[i]), window(i, bs, fs))))))

    def one(v: Column, start: Column, near: Column) -> Column:
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"), _holds(kind, v).alias("ok"))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, build(m)))
    kept = F.filter(F.coalesce(found, F.array()), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
    return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


#: What a text must hold to be searched for a kind at all.
_NEEDS = {"email": "@", "phone": "+"}


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Confirmed spans of a text (not null): array of (kind, start, end, score), by kind as in ``kinds``, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    each = []
    for k in kinds:
        has = F.instr(text, _NEEDS[k.name]) > 0 if k.name in _NEEDS else text.rlike("[0-9][^a-zA-Z]*[0-9]")
        each.append(F.when(has, _spans(text, k)).otherwise(none))
    return F.concat(*each)


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score), by kind as in ``KINDS``, then start."""
    return docs.withColumn(out, spans(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def mask(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with every confirmed span, as ``find_spans`` has them, replaced by its kind's name in angle brackets. Spans are
    those of the text as given; overlapping ones are replaced as one, by the name of the longest
    (ties: the first in ``KINDS``)."""
    def work(t: Column) -> Column:
        return let(spans(F.coalesce(t, F.lit("")), kinds), lambda s: F.when(F.size(s) == 0, t).otherwise(let(_merged(s), lambda m: _replaced(t, m))))
    return let(text, work)


def _merged(found: Column) -> Column:
    """Spans joined where they overlap (not where they touch): array of (start, end, kind), by start."""
    def ends(s: Column, i: Column) -> Column:
        return F.array(F.struct(s["start"].alias("at"), F.lit(1).alias("step"), (s["end"] - s["start"]).alias("size"), (-i).alias("first"), s["kind"].alias("kind")),
                       F.struct(s["end"].alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("size"), (-i).alias("first"), s["kind"].alias("kind")))

    def join(es: Column, depth: Column) -> Column:
        def where(step: int, open_spans: int) -> Column:
            at = F.transform(es, lambda e, i: F.when((e["step"] == step) & (depth[i] == open_spans), i))
            return F.filter(at, lambda i: i.isNotNull())

        def one(a: Column, b: Column) -> Column:
            longest = F.array_max(F.transform(F.slice(es, a + 1, b - a), lambda e: F.struct(e["size"], e["first"], e["kind"].alias("kind"))))
            return F.struct(es[a]["at"].alias("start"), es[b]["at"].alias("end"), longest["kind"].alias("kind"))
        return F.zip_with(where(1, 0), where(-1, 1), one)
    return let(F.sort_array(F.flatten(F.transform(found, ends))),
               lambda es: let(_before(F.transform(es, lambda e: e["step"])), lambda depth: join(es, depth)))


def _replaced(text: Column, found: Column, block: int = 64) -> Column:
    """``text`` with the spans ``found`` (by start, apart, at least one) replaced. In blocks, as
    every substring counts characters from the start of what it is taken from."""
    def end(i: Column) -> Column:
        return F.coalesce(F.get(found, i - 1)["end"], F.lit(0))

    def part(b: Column) -> Column:
        def put(t: Column, base: Column) -> Column:
            body = F.transform(F.slice(found, b * block + 1, F.lit(block)), lambda s, j: let(
                end(b * block + j), lambda e: F.concat(t.substr(e - base + 1, s["start"] - e), F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
            return F.array_join(body, "")
        return let(end(b * block), lambda base: let(
            text.substr(base + 1, end(F.least((b + 1) * block, F.size(found))) - base), lambda t: put(t, base)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), part)
    return F.concat(F.array_join(parts, ""), text.substr(end(F.size(found)) + 1, F.length(text)))
