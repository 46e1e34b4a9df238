"""Stand-in inputs derived from the given tables, for Spark and as SQL text.

The SQL of `artworks` and `bindings` is the same in both engines. Titles are
whole document texts, joined on the document key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Cuts an input of few, large files by key; an input with enough splits stays as it is."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


ARTWORKS = """
select o_orderkey as id,
  case when o_orderkey % 20 = 7 or o_orderkey % 40 = 19 or o_orderkey % 37 = 3 then cast((o_orderkey + 1) % 8 as int)
       when o_orderkey % 41 = 5 then cast((o_orderkey + 3 + o_orderkey % 3) % 8 as int)
       else cast(o_orderkey % 8 as int) end as y,
  case when o_orderkey % 97 = 0 then null else concat('A ',
    case o_orderkey % 8 when 0 then 'Acrylic' when 1 then 'ink' when 2 then 'oil on canvas'
      when 3 then 'oil on panel' when 4 then 'oil on wood' when 5 then 'print'
      when 6 then 'tempera' else 'watercolor' end,
    ' artwork titled "T', cast(o_orderkey as string), '" by ', c_name, '.') end as cap,
  case when o_orderkey % 13 = 0 then null
       else cast(1300 + (o_orderkey * 37) % 720 as double) end as y0,
  case when o_orderkey % 13 = 0 then null
       else cast(1300 + (o_orderkey * 37) % 720 + o_orderkey % 9 as double) end as y1,
  case when o_orderkey % 11 = 0 then null else concat('overall: ',
    cast(1 + o_orderkey % 210 as string), '.5 x ', cast(1 + o_orderkey % 170 as string), ' cm',
    case o_orderkey % 5 when 0 then concat(chr(13), chr(10), 'Framed: 90 x 70 cm')
      when 1 then concat(chr(13), chr(10), 'sheet: 20 x 30 cm')
      when 2 then concat(chr(13), chr(10), 'image: 9 x 7 cm', chr(13), chr(10), 'plate: 10 x 8 cm')
      when 3 then concat(chr(13), chr(10), 'mount: 50 x 40 cm') else '' end) end as dim,
  cast(200 + o_orderkey % 1800 as int) as width,
  cast(200 + (o_orderkey * 7) % 1500 as int) as height,
  concat(cast(1937 + o_orderkey % 80 as string), case when o_orderkey % 17 = 0 then ''
    else concat('.', cast(o_orderkey % 12 as string), '.', cast(o_orderkey % 5 as string)) end) as acc_id,
  case when o_orderkey % 19 = 0 then null else c_name end as attribution,
  case o_orderkey % 5 when 0 then 'Painting' when 1 then 'Drawing' when 2 then 'Print'
    when 3 then 'Photograph' else null end as classification,
  o_orderpriority as visualbrowserclassification,
  c_mktsegment as departmentabbr,
  case when o_orderkey % 7 = 0 then null else 'primary' end as viewtype,
  o_orderstatus as element,
  case when o_orderkey % 3 = 0 then null else 'overall' end as dimensiontype,
  concat(c_mktsegment, '| ', o_orderstatus, '|', o_orderpriority, '|') as cat,
  text as t,
  case when o_orderkey % 20 = 3 then 'reproduced in colour' else null end as txt,
  case when o_orderkey % 9 = 0 then 'gold' else null end as tag,
  case o_orderkey % 8 when 0 then 'Gouache on paper' when 1 then 'etching, plate printed'
    when 2 then 'egg tempera on gold ground' when 3 then 'a pink wash' when 4 then 'pen and brown ink'
    else null end as note,
  case when o_orderkey % 6 = 0 then 'signed lower left' else null end as inscription,
  concat('Gift of ', c_name) as creditline,
  case when o_orderkey % 4 = 0 then 'This drawing shows pink hills in ink.'
    when o_orderkey % 4 = 1 then 'A painting of a harbour, etching beside it.' else null end as assistivetext,
  case when o_orderkey % 31 = 0 then 'v1' else null end as volume,
  case when o_orderkey % 37 = 0 then 'eff' else null end as eff,
  case when o_orderkey % 41 = 0 then 'sub' else null end as subclassification,
  case when o_orderkey % 43 = 0 then 'crown' else null end as watermarks,
  case when o_orderkey % 47 = 0 then 'stamp' else null end as markings,
  case when o_orderkey % 29 = 0 then 'folio' else null end as portfolio,
  case when o_orderkey % 23 = 0 then 'series' else null end as series,
  case when o_orderkey % 5 < 3 then concat('Q', cast(o_orderkey as string)) else null end as wikidataid,
  case when o_orderkey % 5 = 4 then 'test' else 'train' end as split
from {orders} join {customer} on o_custkey = c_custkey
"""
WITH_TEXT = "left join {documents} on doc_id = o_orderkey"

BINDINGS = """
select concat('http://www.wikidata.org/entity/', wikidataid) as item, mat as matlabel
from {artworks} join (
  select 0 as k, 'Oil paint' as mat union all select 0, 'canvas' union all select 1, 'ink' union all select 1, 'ink'
  union all select 1, 'laid paper' union all select 2, 'pencil' union all select 3, 'woodcut'
  union all select 4, 'watercolor paint' union all select 5, 'oil paint' union all select 5, 'poplar'
  union all select 6, 'egg tempera' union all select 6, 'gold leaf' union all select 7, 'acrylic paint'
  union all select 8, 'oil paint' union all select 8, 'panel' union all select 9, 'copper') m
  on k = id % 11 where wikidataid is not null
"""

# Fetch log: one attempt per order line.
ATTEMPTS = "select l_orderkey as id, l_returnflag = 'N' as ok from {lineitem}"


def artworks(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """Record table; the document join is left out where no title is used."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    sql = ARTWORKS
    if texts:
        sql, tables["documents"] = sql + WITH_TEXT, table(spark, sf_dir, "documents")
        tables["orders"] = spread(tables["orders"], "o_orderkey")
    else:
        sql = sql.replace("text as t", "cast(null as string) as t")
    return spark.sql(sql, **tables)


def train_rows(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return artworks(spark, sf_dir, texts).filter("split = 'train'")


def test_rows(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return artworks(spark, sf_dir, texts).filter("split = 'test'")


def raw_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BINDINGS, artworks=artworks(spark, sf_dir))


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vernissage.sources.bindings import uri_key

    return raw_bindings(spark, sf_dir).select(
        uri_key(F.col("item")).alias("item"), F.col("matlabel").alias("label")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATTEMPTS, lineitem=table(spark, sf_dir, "lineitem"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def pixel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 RGB image per embedding as arrays of levels."""
    level = "cast(floor(least(255.0D, greatest(0.0D, (v + 0.5D) * 255.0D))) as int)"
    return embeddings(spark, sf_dir).select("id", "label", F.expr(f"transform(vec, v -> {level})").alias("v"))


def images(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """The images as rows of the image source; with `broken` those of label 9 are unreadable (height -1)."""
    byte = "lpad(hex({}), 2, '0')"
    packed = (
        "unhex(array_join(transform(sequence(0, 63), i -> concat("
        + ", ".join(byte.format(f"get(v, (i + {k}) % 64)") for k in (42, 21, 0))
        + ")), ''))"
    )
    good = "label <> 9" if broken else "true"
    return pixel_levels(spark, sf_dir).select(
        "id",
        F.expr(
            f"named_struct('origin', concat('mem:', id, '.png'), 'height', if({good}, 8, -1), "
            f"'width', if({good}, 8, -1), 'nChannels', if({good}, 3, -1), 'mode', if({good}, 16, -1), "
            f"'data', if({good}, {packed}, cast('' as binary)))"
        ).alias("image"),
    )


def predictions(spark: SparkSession, sf_dir: str, repeats=fixed.BLEND_SEEDS, name: str = "seed", texts: bool = False) -> DataFrame:
    """Deterministic probability arrays, one per record and seed (or fold)."""
    rows = artworks(spark, sf_dir, texts).withColumn(name, F.explode(F.array(*[F.lit(s) for s in repeats])))
    weights = F.expr(
        f"transform(sequence(0, 7), k -> 1 + (id * (k + 3) * {name}) % 97 "
        "+ if(k = y and id % 4 < 3, 200, 0))"
    )
    total = F.expr("aggregate(_weights, 0L, (a, w) -> a + w)")
    return rows.withColumn("_weights", weights).withColumn("_total", total).withColumn(
        "probs", F.expr("transform(_weights, w -> cast(w as double) / cast(_total as double))")
    ).drop("_weights", "_total")


# --- the same inputs as SQL text for the checks -------------------------------------------

_PIXELS_SQL = """
select id, cast(pos % 8 as int) as px, cast(floor(pos / 8.0) as int) as py,
  cast(floor(least(255.0, greatest(0.0, (cast(e[pos + 1] as double) + 0.5) * 255.0))) as int) as r,
  cast(floor(least(255.0, greatest(0.0, (cast(e[(pos + 21) % 64 + 1] as double) + 0.5) * 255.0))) as int) as g,
  cast(floor(least(255.0, greatest(0.0, (cast(e[(pos + 42) % 64 + 1] as double) + 0.5) * 255.0))) as int) as b
from (select vec_id as id, embedding as e, unnest(range(64)) as pos from embeddings)
"""


def _predictions_sql(repeats, name: str) -> str:
    source = " union all ".join(f"select {s} as {name}" for s in repeats)
    classes = " union all ".join(f"select {k} as k" for k in range(fixed.N_CLASSES))
    return f"""
select id, {name}, k, cast(w as double) / cast(sum(w) over (partition by id, {name}) as double) as p
from (select id, {name}, k, 1 + (id * (k + 3) * {name}) % 97
        + case when k = y and id % 4 < 3 then 200 else 0 end as w
      from artworks cross join ({source}) s cross join ({classes}) c) x
"""


_PLAIN = {n: n for n in ("orders", "customer", "documents", "artworks", "lineitem")}

_CAP = r"nullif(lower(trim(regexp_extract(cap, '(?i)A\s+([a-zA-Z ]+?)\s+artwork titled', 1))), '')"
_CODE = "case cap_med " + " ".join(f"when '{m}' then {k}" for k, m in enumerate(fixed.MEDIA)) + " end"

SQL_VIEWS = {
    "artworks": ((), (ARTWORKS + WITH_TEXT).format(**_PLAIN)),
    "train": (("artworks",), "select * from artworks where split = 'train'"),
    "test": (("artworks",), "select * from artworks where split = 'test'"),
    "bindings": (
        ("artworks",),
        "select split_part(item, '/', -1) as item, matlabel as label from ("
        + BINDINGS.format(**_PLAIN) + ")",
    ),
    "attempts": ((), ATTEMPTS.format(**_PLAIN)),
    "pixels": ((), _PIXELS_SQL),
    "grays": (("pixels",), "select *, 299 * r + 587 * g + 114 * b as gray from pixels"),
    "preds": (("artworks",), _predictions_sql(fixed.BLEND_SEEDS, "seed")),
    "fold_preds": (("artworks",), _predictions_sql(range(1, fixed.N_FOLDS + 1), "fold")),
    "captions": (
        ("artworks",),
        f"select *, {_CODE} as cap_y from (select *, {_CAP} as cap_med from artworks)",
    ),
    "folds": (
        ("train",),
        "select id, y, attribution, cast((row_number() over (partition by y order by "
        "md5(concat(cast(id as string), '-42')), id) - 1) % 5 as int) as fold from train",
    ),
    "blend": (("preds",), "select id, k, avg(p) as p from preds group by id, k"),
    "decided": (
        ("blend",),
        "select id, cast(min(k) filter (where p = m) as int) as pred, max(m) as conf from "
        "(select id, k, p, max(p) over (partition by id) as m from blend) group by id",
    ),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a check with the stand-in views it names and those they build on."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            need(parent)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        need(n)
    return "with " + ",\n".join(f"{n} as ({SQL_VIEWS[n][1]})" for n in ordered) + "\n" + sql
