"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is DataFrame functions over whole texts. Each pattern is written so that the Java
engine neither backtracks over long runs nor recurses: possessive repeats, and a start only
where a run starts or the previous match ended (``\\G``), which is where the leftmost match of
the plain pattern starts too. Offsets come from the pieces between matches (``split``), since
no built-in function returns positions.

Null and empty texts have no spans. Rows are independent, so repeated rows repeat their
result and an empty table gives an empty one. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from .common import packed, unpacked

#: Running sums work in blocks, so that a text with m matches costs about m * sqrt(m).
BLOCK = 128
#: Code points before and after a span in which context words count, at most up to the next
#: match of the same pattern.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    #: A text without this pattern has no match; cheaper to test than the regex.
    needs: str
    #: Score of a span the validator confirms, and what a context word adds.
    prior: float
    words: str
    mask: str


# The kinds in output order, and the words that speak for each.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         "mail|e-mail|contact|write", "[EMAIL]"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|address|host|server|client", "[IP]"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.8, "card|visa|mastercard|credit|payment", "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax", "[PHONE]"),
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", "", 0.9,
         "iban|bank|account|transfer", "[IBAN]"),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
            i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its checksum: first four signs moved last, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return mod97(text)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; an expression used twice would run twice."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Sum of all numbers before each place of an array (a variable or column), in two levels."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def within(parts: Column, sums: Column) -> Column:
        return F.flatten(F.transform(parts, lambda block, b: _let(
            total(F.slice(sums, F.lit(1), b)),
            lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, F.lit(1), i))))))

    return _let(blocks, lambda parts: _let(F.transform(parts, total), lambda sums: within(parts, sums)))


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _spans(kind: Kind, text: Column) -> Column:
    """Valid spans of one kind, in order."""
    pattern = F.lit(kind.regex)
    near = lambda p: F.regexp_like(p["around"], F.lit(rf"(?i)\b(?:{kind.words})\b"))

    def placed(steps: Column) -> Column:
        starts = _let(F.transform(steps, lambda p: p["gap"] + p["size"]), _running)
        return F.transform(F.arrays_zip(steps.alias("step"), starts.alias("before")), lambda p: F.struct(
            p["step"]["value"].alias("value"), (p["before"] + p["step"]["gap"]).alias("start"),
            p["step"]["size"].alias("size"), p["step"]["around"].alias("around")))

    def steps(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda value, i: F.struct(
            value.alias("value"), F.length(gaps[i]).alias("gap"), F.length(value).alias("size"),
            F.concat(F.right(gaps[i], F.lit(CONTEXT)), F.lit("\n"), F.left(gaps[i + 1], F.lit(CONTEXT))).alias("around")))

    every = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: _let(
        F.split(text, kind.regex, -1), lambda gaps: _let(steps(found, gaps), placed)))
    spans = F.transform(F.filter(every, lambda p: _valid(kind.name, p["value"])), lambda p: F.struct(
        F.lit(kind.name).alias("kind"), p["start"].alias("start"), (p["start"] + p["size"]).alias("end"),
        p["value"].alias("value"), (F.lit(kind.prior) + F.when(near(p), 0.1).otherwise(0.0)).alias("score")))
    if kind.needs:
        possible = F.contains(text, F.lit(kind.needs))
    else:
        possible = F.regexp_like(text, F.lit("[0-9]"))
    return F.when(possible & F.regexp_like(text, pattern), spans).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least_score: float = 0.0) -> DataFrame:
    """Adds ``pii``: spans (kind, start, end, value, score) by kind and start, of at least that score."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[_spans(k, text) for k in kinds])
    if least_score > 0:
        found = F.filter(found, lambda s: s["score"] >= least_score)
    return docs.withColumn("pii", found)


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replaces every valid span by the mask of its kind; other columns and texts stay as they are.

    Of overlapping spans the one that starts first counts, then the longer; what the other
    has beyond it is masked too.
    """
    marked = find_pii(packed(docs, "text"), kinds)
    marked = staged(marked, pii=F.col("pii"))
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("till"), s["kind"].alias("kind"))))
    mask = F.create_map(*[x for k in kinds for x in (F.lit(k.name), F.lit(k.mask))])
    text = F.col("text")
    # Spans in order: what lies between the furthest end so far and the span stays.
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["till"]).alias("at"),
            F.when(-s["till"] <= acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(
                F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                mask[s["kind"]]))).alias("parts")),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1)))
    return unpacked(marked, docs, "text", text=F.when(F.size("pii") > 0, state).otherwise(text))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, from the operator's spans."""
    shown = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda name: F.filter("pii", lambda s: s["kind"] == name)
    found = staged(find_pii(docs.select("doc_id", "text")).drop("text"), pii=F.col("pii"))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(shown(F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        shown(F.col("pii")).alias("spans"),
        F.transform("pii", lambda s: s["score"]).alias("scores"))
