"""One query per operator, and check SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage.llm import chat, divergence, exact, licenses, mixing, packing, phrases, pii, quality, secrets, simhash, substring, vectors
from vernissage.llm.text import table

QUERIES = {}
CHECKS = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


CHECKS["op7_mixing"] = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '-7'), 1, 13)) as bigint) + 0.5::double)
      / 4503599627370496.0::double as u
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
placed as (select *, row_number() over (order by source nulls last) as place from totals),
weighed as (select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
    2.0::double * source_size as cap from placed),
leveled as (select *, (1.5::double * cast(sum(source_size) over () as double)
      - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, place rows between current row and unbounded following) as level
  from weighed),
settled as (select *, cap / w <= level as capped,
    (select l.level from leveled l where l.cap / l.w > l.level order by l.cap / l.w, l.place limit 1) as final
  from leveled),
targets as (select source, source_size, case when capped then cap else w * final end as target from settled),
plans as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole
  from targets),
opened as (select *, target - whole * source_size as open from plans),
ordered as (select d.doc_id, d.size, o.source_size, o.target, o.whole, o.open,
    case when o.source_size <= 0 or o.open / o.source_size <= 0 then null
      else (u / (1 - u)) / ((o.open / o.source_size) / (1 - o.open / o.source_size)) end as odds, o.source
  from sized d join opened o on d.source is not distinct from o.source),
summed as (select *, coalesce(sum(size) over (partition by source order by odds nulls last, doc_id, size
    rows between unbounded preceding and 1 preceding), 0) as earlier from ordered)
select doc_id, size, source_size, target,
  cast((whole + case when odds is not null and earlier + size / 2.0 <= open then 1 else 0 end) * size as bigint) as taken
from summed
"""


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_duplicates(spark, docs).drop("content")


CHECKS["op8_exact_dedup"] = r"""
with told as (
  select doc_id, length(coalesce(text, '')) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
ranked as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id nulls last) as keep_id,
    row_number() over (partition by text_sha256 order by points desc, doc_id nulls last) as place from told)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from ranked
"""


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(told.unionByName(own)))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


CHECKS["op12_source_divergence"] = r"""
with told as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
terms as (select id, lang, source, unnest(words) as term from told),
kept as (select lang, term from terms group by lang, term having count(distinct id) >= 30),
counts as (
  select t.lang, t.source, t.term, count(*) as n from terms t semi join kept k on t.lang = k.lang and t.term = k.term
  group by t.lang, t.source, t.term),
vocabulary as (select lang, count(*) as v from kept group by lang),
sums as (select lang, source, sum(n) as total from counts group by lang, source),
groups as (
  select g.lang, g.source, coalesce(s.total, 0)::hugeint as total, coalesce(v.v, 0)::hugeint as v
  from (select distinct lang, source from told) g
  left join sums s on g.lang = s.lang and g.source = s.source left join vocabulary v on g.lang = v.lang),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p
  from groups g join kept k on g.lang = k.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * count(*) over (partition by lang)) as q
  from shares group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, cast(coalesce(sum(abs(x.p - y.p)), 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source
  left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
above as (
  select s.lang, s.source, s.term as item, cast(s.p - w.q as bigint) as value
  from shares s join whole w on s.lang = w.lang and s.term = w.term where s.n > 0 and s.p > w.q)
select lang, source, 'pair' as part, item, value,
  cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value,
  cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from above) where rank <= 50
"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


CHECKS["op11_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
told as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sums as (select lang, cast(sum(len(w)) as hugeint) as n from told group by lang),
placed as (select lang, w, unnest(generate_series(1, len(w))) as i from told where len(w) > 0),
grams as (
  select lang, k as words, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase, count(*) as f
  from placed, generate_series(1, 5) t(k) where i + k - 1 <= len(w) group by all having count(*) >= 100),
cuts as (
  select g.lang, g.phrase, g.words, g.f, k,
    array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') as head,
    array_to_string(list_slice(string_split(phrase, ' '), k + 1, words), ' ') as rest
  from grams g, generate_series(1, 4) t(k) where k < words),
scored as (
  select c.lang, c.phrase, c.words, c.f as a, c.k, h.f as l, r.f as r, s.n,
    (1000::hugeint * c.f * s.n) // (h.f::hugeint * r.f) as score
  from cuts c join grams h on h.lang = c.lang and h.phrase = c.head join grams r on r.lang = c.lang and r.phrase = c.rest
  join sums s on s.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select g.lang, array_to_string(list_slice(string_split(phrase, ' '), i, i + m - 1), ' ') as phrase, max(f) as f
  from grams g, generate_series(2, 4) t(m), generate_series(1, 4) u(i) where m < words and i + m - 1 <= words group by all),
left_ as (select b.* from best b left join inner_ x on x.lang = b.lang and x.phrase = b.phrase where x.f is null or 100 * x.f < 100 * b.a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_) where rank <= 2000
"""
