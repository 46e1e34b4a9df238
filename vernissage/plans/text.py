"""Text vectors over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import text_vectors as tv
from vernissage.plans import views
from vernissage.plans.registry import query

_WORDS = f"""
words as (
  select id, part, w, count(*) as n from (
    select doc_id as id, doc_id % 5 <> 4 as part,
      unnest(regexp_split_to_array(lower(text), '{fixed.WORD_GAP}')) as w from documents)
  where w <> '' group by 1, 2, 3)"""
_GRAMS = """
grams as (
  select id, part, substring(' ' || w || ' ', cast(i as int), cast(k as int)) as ngram, cast(sum(n) as bigint) as tf
  from (select id, part, w, n, k, unnest(range(1, length(w) + 4 - k)) as i
        from words cross join (select unnest([3, 4, 5]) as k) where k <= length(w) + 2)
  group by 1, 2, 3)"""


def _fitted(scope: str) -> str:
    """Vocabulary and idf learned on the documents a predicate selects."""
    return f"""
vocab as (select ngram, cast(sum(tf) as bigint) as total from grams where {scope}
  group by 1 order by total desc, ngram limit {fixed.MAX_NGRAMS}),
idf as (select ngram, count(*) as df,
    ln((1.0::double + (select count(*) from documents where {scope.replace('part', 'doc_id % 5 <> 4')}))
       / (1.0::double + count(*))) + 1.0::double as idf
  from grams join vocab using (ngram) where {scope} group by 1),
raw as (select id, part, ngram, (1 + ln(tf)) * idf as w from grams join idf using (ngram)),
weights as (select id, part, ngram, w / sqrt(sum(w * w) over (partition by id)) as weight from raw)"""


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


def documents(spark, sf):
    """Whole texts; every fifth document plays the unseen part in the transform query."""
    docs = views.spread(views.table(spark, sf, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 5 != 4).alias("part")
    )


@query("char_ngrams", _with(_WORDS, _GRAMS) + " select id, ngram, tf from grams")
def char_ngrams(spark, sf):
    return tv.document_ngrams(documents(spark, sf))


@query("ngram_vocab", _with(_WORDS, _GRAMS, _fitted("true")) + " select ngram, total from vocab")
def ngram_vocab(spark, sf):
    return tv.fit_vocabulary(documents(spark, sf))


@query(
    "tfidf_weights",
    _with(_WORDS, _GRAMS, _fitted("true")) + " select id, ngram, round(weight, 6) as weight from weights",
)
def tfidf_weights(spark, sf):
    fitted, counts = tv.fit_counts(documents(spark, sf))
    return tv.long_form(tv.weigh(counts, fitted), fitted).withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_transform",
    _with(_WORDS, _GRAMS, _fitted("part"))
    + " select id, ngram, round(weight, 6) as weight from weights where not part",
)
def tfidf_transform(spark, sf):
    docs = documents(spark, sf)
    fitted, _ = tv.fit_counts(docs.filter("part"))
    rows = tv.transform(docs.filter("not part"), fitted)
    return tv.long_form(rows, fitted).withColumn("weight", F.round("weight", 6))
