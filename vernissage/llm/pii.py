"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Column expressions only, so a scan with this operator stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spans every caller can rely on, and what confirms them.
_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Each pattern gives the matches of the plain form, leftmost and without overlap. A match can begin
# inside a run of its first characters only where the match before it ended (\G), and possessive
# quantifiers stand where giving characters back could never help, so scans stay linear.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# A run of digits with single separators; runs below 13 digits hold no card number of any kind.
DIGITS = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    `hint` is a cheap test a text must pass to be scanned, `valid` an SQL
    condition on the match `m`; a match stays when it is valid and, unless the
    kind is a base kind, its score reaches `keep`. With `cut` the longest valid part
    up to a space stands for the match, as the pattern may take words after it.
    """

    name: str
    pattern: str
    hint: str
    valid: str
    score: float
    context: str
    base: bool = True
    keep: float = 0.0
    cut: bool = False


_COMPACT = "replace(m, ' ', '')"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: the digit string passes the Luhn checksum."""
    doubled = "cast(substring({d}, -i, 1) as int) * (2 - i % 2)".format(d=digits)
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + ({doubled}) % 10 + int(({doubled}) / 10)) % 10 = 0"


def mod97(compact: str) -> str:
    """SQL: the account number passes the mod-97 checksum; letters count 10 to 35."""
    turned = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    step = "case when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end"
    return f"aggregate(split({turned}, ''), 0, (a, c) -> if(c = '', a, {step})) = 1"


def _card(low: int, high: int) -> str:
    d = _digits("m")
    return f"length({d}) between {low} and {high} and case when length({d}) <= {high} then {luhn(d)} else false end"


KINDS = (
    Kind("email", EMAIL, "contains(t, '@')", "true", 0.9, "mail|contact|write|reach"),
    Kind("ip", IP, "contains(t, '.') and t rlike '[0-9][.][0-9]'", rf"m rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$'", 0.6, "ip|host|server|address|login"),
    Kind("card", DIGITS, "t rlike '[0-9]'", _card(16, 19), 0.8, "card|visa|master|credit|debit|pay"),
    Kind("phone", PHONE, "contains(t, '+')", f"length({_digits('m')}) between 8 and 15", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, "t rlike '[A-Z][A-Z][0-9][0-9]'", f"length({_COMPACT}) between 15 and 34 and {mod97(_COMPACT)}", 0.9, "iban|bank|account|transfer", base=False, keep=0.5, cut=True),
    Kind("shortcard", DIGITS, "t rlike '[0-9]'", _card(13, 15), 0.4, "card|amex|diners|credit|debit", base=False, keep=0.5),
)
REACH = 40
BONUS = 0.2


def _matches(kind: Kind) -> tuple[Column, Column]:
    """Matches, and the pieces of text between them, for texts that pass the hint."""
    t, none = F.col("t"), F.array().cast("array<string>")
    hit = F.expr(kind.hint)
    return (
        F.when(hit, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(none),
        F.when(hit, F.split(t, kind.pattern, -1)).otherwise(none),
    )


def _placed(k: int) -> Column:
    """Matches with start and end in code points: a running sum of piece and match lengths."""
    step = f"""named_struct('at', acc.at + length(p{k}[i]) + length(m{k}[i]), 'out', array_append(acc.out,
        named_struct('m', m{k}[i], 's', acc.at + length(p{k}[i]), 'e', acc.at + length(p{k}[i]) + length(m{k}[i]))))"""
    none = "cast(array() as array<struct<m:string,s:int,e:int>>)"
    return F.expr(
        f"if(size(m{k}) = 0, {none}, aggregate(sequence(0, size(m{k}) - 1), "
        f"named_struct('at', 0, 'out', {none}), (acc, i) -> {step}, acc -> acc.out))"
    )


def _valid(k: int, kind: Kind) -> str:
    """SQL: the matches that are valid, cut where the kind says so."""
    if not kind.cut:
        return f"filter(x{k}, x -> transform(array(x.m), m -> {kind.valid})[0])"
    words = "split(x.m, ' ')"
    parts = f"filter(transform(sequence(1, size({words})), i -> array_join(slice({words}, 1, i), ' ')), m -> {kind.valid})"
    longest = f"transform(array({parts}), c -> get(c, size(c) - 1))[0]"
    cut = f"transform(x{k}, x -> transform(array({longest}), m -> named_struct('m', m, 's', x.s, 'e', x.s + length(m)))[0])"
    return f"filter({cut}, x -> x.m is not null)"


def _scored(k: int, kind: Kind) -> Column:
    around = f"lower(substring(t, greatest(x.s - {REACH}, 0) + 1, x.e - greatest(x.s - {REACH}, 0) + {REACH}))"
    near = f"{around} rlike '{kind.context}'"
    score = f"least(1.0D, {kind.score}D + if({near}, {BONUS}D, 0.0D))"
    scored = f"transform({_valid(k, kind)}, x -> named_struct('s', x.s, 'e', x.e, 'score', {score}))"
    return F.expr(scored if kind.base else f"filter({scored}, x -> x.score >= {kind.keep}D)")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(key, one array of (s, e, score) per kind) for every row of `docs`.

    Offsets are code points, `e` exclusive. Spans of one kind do not overlap;
    spans of different kinds may. Null and empty texts have no spans. Repeated
    rows are scanned each, other columns are ignored, an empty table gives no
    rows. A text is scanned whole, in one pass per pattern.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    patterns = list(dict.fromkeys(kind.pattern for kind in kinds))
    first = {kind.pattern: kind for kind in reversed(kinds)}
    found = rows.select("k", "t", *[c.alias(f"{n}{i}") for i, p in enumerate(patterns) for n, c in zip("mp", _matches(first[p]), strict=True)])
    placed = found.select("k", "t", *[_placed(i).alias(f"x{i}") for i in range(len(patterns))])
    return placed.select(F.col("k").alias(key), *[_scored(patterns.index(kind.pattern), kind).alias(kind.name) for kind in kinds])


def joined(kinds: tuple[Kind, ...], form: str = "x.s, ':', x.e") -> Column:
    """Comma-joined kind:start:end of the given kinds, by kind and then by start."""
    lists = [F.expr(f"transform({kind.name}, x -> concat('{kind.name}:', {form}))") for kind in kinds]
    return F.array_join(F.concat(*lists), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts per base kind, all spans as one string, a digest of the base spans and the scores."""
    spans = find_personal_data(docs, key, text, kinds)
    base = tuple(kind for kind in kinds if kind.base)
    return spans.select(
        key,
        *[F.size(kind.name).cast("long").alias(f"n_{kind.name}") for kind in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(kinds).alias("spans"),
        joined(kinds, "x.s, ':', format_number(x.score, 2)").alias("scores"),
    )
