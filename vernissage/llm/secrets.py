"""Secrets: patterns propose parts of credentials, weak parts count only next to the parts that complete them.

Column expressions, joins on keys and windows only, so the work stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.session import land

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
# Two parts belong together when at most this many code points lie between them and no empty line does.
REACH = 200
_BUCKET = 8 * REACH
# Running sums add up blocks of this many lengths, so that a text with many matches costs little more than its matches.
_BLOCK = 256

# The spans every caller can rely on, and what drops a match of theirs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# The whole runs of the plain form; a match begins where a run does.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

NAMED = r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
SHORT = r"""(?<![A-Za-z0-9])(?i:pass|pwd|passphrase|pin|auth|bearer|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!#%&*-]{4,})"""
OPAQUE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}"
PLACE = r"(?<![A-Za-z0-9])(?i:https?|ftp|sftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20\"'<>\x7F]++"
_EMPTY_LINE = r"\n[\x20\t\r]*\n"


@dataclass(frozen=True)
class Part:
    """One kind of part of a credential.

    `hint` is a cheap test a text must pass to be scanned, `valid` an SQL
    condition on the match `m`. Base parts are always reported; others are weak
    and need complementary parts within reach: an identifier needs a secret, a
    secret needs an identifier, an endpoint needs both.
    """

    name: str
    pattern: str
    hint: str
    valid: str
    role: str
    base: bool = False


def _value(pattern: str) -> str:
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract(m, '{quoted}', 1)"


PARTS = (
    Part("assign", ASSIGN, "t rlike '(?i)passw|secret|token|api_?key'", f"length({_value(ASSIGN)}) >= 12", SECRET, base=True),
    Part("access", ACCESS, "contains(t, 'AKIA')", "length(m) >= 18", IDENTIFIER, base=True),
    Part("hex", HEX, "true", "true", SECRET, base=True),
    Part("identifier", NAMED, "t rlike '[:=]'", "true", IDENTIFIER),
    Part("shortsecret", SHORT, "t rlike '[:=]'", "true", SECRET),
    Part("weakassign", ASSIGN, "t rlike '(?i)passw|secret|token|api_?key'", f"length({_value(ASSIGN)}) between 4 and 11", SECRET),
    Part("opaque", OPAQUE, "true", "m rlike '[a-z]' and m rlike '[A-Z]' and m rlike '[0-9]'", SECRET),
    Part("endpoint", PLACE, "contains(t, '://')", "true", ENDPOINT),
)


def _matches(pattern: str, hint: str, text: str = "t") -> tuple[Column, Column]:
    """Matches, and the pieces of text between them, for texts that pass the hint."""
    t, none, hit = F.col(text), F.array().cast("array<string>"), F.expr(hint)
    return (
        F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none),
        F.when(hit, F.split(t, pattern, -1)).otherwise(none),
    )


def _placed(m: str, p: str) -> str:
    """SQL: array of (m, s, e) in code points; running sums inside blocks, after sums of whole blocks."""
    none = "cast(array() as array<struct<m:string,s:int,e:int>>)"
    width = f"length({p}[i]) + length({m}[i])"
    top = f"least(b + {_BLOCK}, size({m})) - 1"
    totals = f"transform(sequence(0, size({m}) - 1, {_BLOCK}), b -> struct(b as b, aggregate(sequence(b, {top}), 0, (a, i) -> a + {width}) as w))"
    starts = f"""aggregate({totals}, named_struct('at', 0, 'out', cast(array() as array<struct<b:int,at:int>>)),
        (acc, x) -> named_struct('at', acc.at + x.w, 'out', array_append(acc.out, named_struct('b', x.b, 'at', acc.at))), acc -> acc.out)"""
    step = f"""named_struct('at', acc.at + {width}, 'out', array_append(acc.out,
        named_struct('m', {m}[i], 's', acc.at + length({p}[i]), 'e', acc.at + {width})))"""
    inside = f"""transform({starts}, x -> aggregate(sequence(x.b, least(x.b + {_BLOCK}, size({m})) - 1),
        named_struct('at', x.at, 'out', {none}), (acc, i) -> {step}, acc -> acc.out))"""
    return f"if(size({m}) = 0, {none}, flatten({inside}))"


def proposed_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: tuple[Part, ...] = PARTS) -> DataFrame:
    """(key, `found`, `breaks`): parts of a text as (kind, role, base, s, e), and starts of empty lines where weak parts need them."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    patterns = list(dict.fromkeys(part.pattern for part in parts))
    hints = {part.pattern: part.hint for part in parts}
    scanned = rows.select("k", "t", *[c.alias(f"{n}{i}") for i, p in enumerate(patterns) for n, c in zip("mp", _matches(p, hints[p]), strict=True)])
    placed = scanned.select("k", "t", *[F.expr(_placed(f"m{i}", f"p{i}")).alias(f"x{i}") for i in range(len(patterns))])
    kinds = []
    for part in parts:
        own = f"filter(x{patterns.index(part.pattern)}, x -> transform(array(x.m), m -> {part.valid})[0])"
        fields = f"'kind', '{part.name}', 'role', '{part.role}', 'base', {str(part.base).lower()}, 's', x.s, 'e', x.e"
        kinds.append(F.expr(f"transform({own}, x -> named_struct({fields}))"))
    found = placed.select("k", "t", F.flatten(F.array(*kinds)).alias("found"))
    open_ = "exists(found, x -> not x.base) and exists(found, x -> x.role = 'identifier') and exists(found, x -> x.role = 'secret')"
    lines = found.select("k", "found", *[c.alias(n) for n, c in zip("mp", _matches(_EMPTY_LINE, open_), strict=True)])
    return lines.select(F.col("k").alias(key), "found", F.expr(f"transform({_placed('m', 'p')}, x -> x.s)").alias("breaks"), F.expr(open_).alias("open"))


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with complementary parts within reach and scope, of (row, found, breaks).

    An interval join by buckets: each part and each empty line goes to every
    bucket of its text that its reach touches; inside a bucket one ordered pass
    tells every weak part the nearest identifier and secret before and after it,
    and what any bucket found counts. A bucket holds a bounded stretch of one
    text, so neither a very long text nor one with very many parts is in one
    task, and no pairs are made.
    """
    every = F.explode(F.sequence(F.floor((F.col("s") - reach - 1) / _BUCKET), F.floor((F.col("e") + reach) / _BUCKET)))
    spans = parts.select("row", F.explode("found").alias("x")).select("row", "x.*")
    breaks = parts.select("row", F.explode("breaks").alias("s")).select(
        "row", F.lit(None).cast("string").alias("kind"), F.lit("break").alias("role"), F.lit(True).alias("base"), "s", F.col("s").alias("e")
    )
    dealt = spans.unionByName(breaks).select("*", every.alias("bucket"))
    cell = Window.partitionBy("row", "bucket")
    # Parts may overlap; the nearest one before a part is the one that ends last among those that start earlier.
    before = cell.orderBy("s", "e", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = cell.orderBy("s", "e", "kind").rowsBetween(1, Window.unboundedFollowing)
    role = lambda r, value: F.when(F.col("role") == r, F.col(value))
    seen = dealt.select(
        "*",
        *[F.max(role(r, "e")).over(before).alias(f"{r}_before") for r in (IDENTIFIER, SECRET)],
        *[F.min(role(r, "s")).over(after).alias(f"{r}_after") for r in (IDENTIFIER, SECRET)],
        F.max(role("break", "s")).over(before).alias("scope_from"),
        F.min(role("break", "s")).over(after).alias("scope_to"),
    ).filter((F.col("role") != "break") & ~F.col("base"))

    def near(r: str) -> Column:
        earlier = (F.col(f"{r}_before") >= F.col("s") - reach) & (F.col("scope_from").isNull() | (F.col(f"{r}_before") > F.col("scope_from")))
        later = (F.col(f"{r}_after") <= F.col("e") + reach) & (F.col("scope_to").isNull() | (F.col(f"{r}_after") < F.col("scope_to")))
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    told = seen.groupBy("row", "kind", "role", "s", "e").agg(F.max(near(IDENTIFIER)).alias("to_identifier"), F.max(near(SECRET)).alias("to_secret"))
    whole = F.when(F.col("role") == IDENTIFIER, F.col("to_secret")).when(F.col("role") == SECRET, F.col("to_identifier")).otherwise(F.col("to_identifier") & F.col("to_secret"))
    return told.filter(whole).select("row", "kind", "role", "s", "e")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: tuple[Part, ...] = PARTS, reach: int = REACH) -> DataFrame:
    """(key, base, linked) for every row of `docs`: arrays of (kind, s, e), offsets in code points, `e` exclusive.

    `base` has the spans of the base kinds, leftmost and without overlap per
    kind; `linked` the weak ones that complementary parts complete. Spans of
    different kinds may overlap; a weak span is left out where a base span of
    the same role covers it. Null and empty texts have no spans. Repeated rows
    are scanned each, a null key is a key like any other, an empty table gives
    no rows; other columns are ignored. Texts are scanned whole, in one pass per
    pattern. What is found is written to the shared folder once, so a lost
    executor changes neither spans nor row numbers.
    """
    found = proposed_parts(docs, key, text, parts).select(F.col(key).alias("key"), "found", "breaks", "open", F.monotonically_increasing_id().alias("row"))
    found = land(found, "secret-parts")
    weak = linked_parts(found.filter("open").select("row", "found", "breaks"), reach)
    grouped = weak.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind", "role"))).alias("weak"))
    strong = "filter(found, x -> x.base)"
    covered = f"exists({strong}, b -> b.role = w.role and b.s <= w.s and b.e >= w.e)"
    linked = f"transform(filter(coalesce(weak, cast(array() as array<struct<s:int,e:int,kind:string,role:string>>)), w -> not {covered}), w -> named_struct('kind', w.kind, 's', w.s, 'e', w.e))"
    return found.join(grouped, "row", "left").select(
        F.col("key").alias(key), F.expr(f"transform({strong}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))").alias("base"), F.expr(linked).alias("linked")
    )


def _listed(spans: str, order: list[str]) -> Column:
    """kind:start:end by start, then kind in the given order."""
    place = f"array_position(array({', '.join(repr(n) for n in order)}), x.kind)"
    ranked = f"sort_array(transform({spans}, x -> named_struct('s', x.s, 'k', {place}, 'e', x.e, 'kind', x.kind)))"
    return F.array_join(F.expr(f"transform({ranked}, x -> concat(x.kind, ':', x.s, ':', x.e))"), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: tuple[Part, ...] = PARTS, reach: int = REACH) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as one string."""
    found = find_secrets(docs, key, text, parts, reach)
    order = [part.name for part in parts]
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{part.name}')) as bigint)").alias(f"n_{part.name}") for part in parts if part.base]
    return found.select(
        key,
        *counts,
        F.sha2(_listed("base", order), 256).alias("base_sha256"),
        _listed("concat(base, linked)", order).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
