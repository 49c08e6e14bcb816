"""Queries that write a table of the driver's in a file format, read it back through its reader, and return what came back.

Files go to the folder of spark.checkpoint.dir, which driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import text as tx
from lexigrid.functions import vectors as vx
from lexigrid.operators import cooc, counts, doc_vectors
from lexigrid.operators.runtime import checkpoint_dir, settle
from lexigrid.plans.reference_queries import _cooc_sql, _docs, _vocab_sql, _vocabulary, cooc_weighted, query, table
from lexigrid.sources import readers, sinks


def _place(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


#: One line of text: a field of a line-based format.
_FLAT = r"regexp_replace(coalesce(text, ''), '[\x{0A}-\x{0D}\x{85}\x{2028}\x{2029}\x{09}]+', ' ', 'g')"


def _flat(name: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\x{0A}-\x{0D}\x{85}\x{2028}\x{2029}\x{09}]+", " ")


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none"))).alias("label"), _flat().alias("text"))


def _ordered_file(rows: DataFrame, value, order: str, path: str) -> str:
    """Text files in the order of a column, by name and line, as formats that go by line number need."""
    rows.orderBy(order).select(value.alias("value")).write.text(path)
    return path


def _record(sep: str, *names: str):
    """A line of quoted fields."""
    return F.concat_ws(sep, *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in names]).alias("value")


#: Spark's writer cuts off blanks and control characters at the ends of fields otherwise.
_WHOLE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query(f"select coalesce(lang, 'none') as label, {_FLAT} as text, count(*) as n from documents group by all")
def read_labelled(spark, sf_dir):
    """Labels before the colon and quoted texts of a tab-separated file."""
    path = _place(spark)
    _labelled(spark, sf_dir).select(_record("\t", "label", "text")).write.text(path)
    found = readers.labelled(spark, path, split_label=True)
    return found.groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query(f"select coalesce(lang, 'none') || ':' || coalesce(source, 'none') as label, {_FLAT} as text, count(*) as n from documents group by all")
def read_labelled_titles(spark, sf_dir):
    """Label and text of comma-separated label, title, text."""
    path = _place(spark)
    rows = _labelled(spark, sf_dir).select("label", F.lit('a "title", long').alias("title"), "text")
    rows.select(_record(",", "label", "title", "text")).write.text(f"{path}/dbpedia_train.csv")
    return readers.dbpedia(spark, path, ("train",))["train"].groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with own as (select doc_id, quality, regexp_replace({_FLAT}, '^[{tx.WS}]+|[{tx.WS}]+$', '', 'g') as text from documents join labels using (doc_id))
    select (row_number() over (order by quality, doc_id) - 1)::bigint as doc_id, text, quality as label from own"""
)
def read_file_per_class(spark, sf_dir):
    """Stripped lines of one file for each class, numbered through both."""
    path = _place(spark)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", _flat().alias("text"))
    for quality, name in ((0, "neg"), (1, "pos")):
        _ordered_file(rows.where(F.col("quality") == quality), F.col("text"), "doc_id", f"{path}/rt-polarity.{name}")
    return readers.mr(spark, path)


@query(
    f"""with own as (select conv_id, turn, {_FLAT} as a, role from conversations),
    pair as (select a.a as text1, b.a as text2, a.turn as turn, a.role as role from own a join own b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
    every as (select 'sick_e' as kind, text1, text2, role as label from pair union all select 'sick_r', text1, text2, (turn / 2.0)::double::varchar from pair
    union all select 'mrpc', text1, text2, turn::varchar from pair
    union all select 'sts', regexp_replace(text1, '^[{tx.WS}]+|[{tx.WS}]+$', '', 'g'), regexp_replace(text2, '^[{tx.WS}]+|[{tx.WS}]+$', '', 'g'), (turn / 2.0)::double::varchar from pair)
    select kind, text1, text2, label, count(*) as n from every group by all"""
)
def read_pairs(spark, sf_dir):
    """Sentence pairs of three tab-separated layouts."""
    path = _place(spark)
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", _flat().alias("text1"), "role")
    pair = own.join(own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text1").alias("text2")), ["conv_id", "turn"])
    half = (F.col("turn") / 2.0).cast("string")
    tsv = pair.select(F.monotonically_increasing_id().alias("pair_ID"), F.col("text1").alias("sentence_A"), F.col("text2").alias("sentence_B"), half.alias("relatedness_score"), F.col("role").alias("entailment_judgment"))
    tsv.write.options(**_WHOLE).option("sep", "\t").option("header", True).option("quote", '"').option("escape", "\\").csv(f"{path}/sick")
    line = lambda *cells: F.concat_ws("\t", *cells)
    head = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("Quality\t#1 ID\t#2 ID\t#1 String\t#2 String").alias("line"))
    body = pair.select(F.monotonically_increasing_id().alias("at"), line(F.col("turn").cast("string"), F.lit("1"), F.lit("2"), "text1", "text2").alias("line"))
    _ordered_file(head.unionByName(body), F.col("line"), "at", f"{path}/mrpc")
    pair.select(line(F.lit("g"), F.lit("f"), F.lit("y"), F.lit("0"), half, "text1", "text2").alias("value")).write.text(f"{path}/sts")
    found = None
    for kind, rows in (("sick_e", readers.sick(spark, f"{path}/sick")), ("sick_r", readers.sick(spark, f"{path}/sick", similarity=True)), ("mrpc", readers.mrpc(spark, f"{path}/mrpc")), ("sts", readers.sts(spark, f"{path}/sts"))):
        own = rows.select(F.lit(kind).alias("kind"), "text1", "text2", F.col("label").cast("string").alias("label"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("kind", "text1", "text2", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with own as (select {_FLAT} as text from documents), c as (select unnest(regexp_extract_all(text, '{tx.SPLIT_RX}')) as word from own) select word, count(*) as \"count\" from c group by word having count(*) >= 5")
def read_corpus(spark, sf_dir):
    """Word counts of a corpus file, a document a line."""
    path = _place(spark)
    table(spark, sf_dir, "documents").select(_flat().alias("value")).write.text(path)
    return counts.word_counts(readers.corpus(spark, path), min_count=5)


@query(f"with {_vocab_sql()} select word, id from vocab")
def read_vocabulary(spark, sf_dir):
    """The vocabulary from its text file, ids by line."""
    path = _place(spark)
    sinks.vocabulary_text(_vocabulary(spark, sf_dir), path)
    return readers.vocabulary_file(spark, path)


@query(
    """select 'v' || vec_id as word, unnest(range(8))::int as dim, round(unnest(embedding[1:8])::double, 6) + 0.0 as x from embeddings where vec_id < 300 and label = 1"""
)
def read_word_vectors(spark, sf_dir):
    """The first 300 lines of a text file of vectors, their first 8 numbers, and of a vocabulary's words only."""
    path = _place(spark)
    rows = table(spark, sf_dir, "embeddings")
    _ordered_file(rows, F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")), "vec_id", path)
    wanted = rows.where("label = 1").select(F.concat(F.lit("v"), F.col("vec_id")).alias("word"))
    found = readers.word_vectors(spark, path, wanted, first=300, dimension=8)
    return doc_vectors.long_form(found.select("word", vx.doubles(F.col("vec")).alias("vec")), "word", decimals=6)


@query("select 'v' || vec_id as word, unnest(range(64))::int as dim, round(unnest(embedding)::double, 6) + 0.0 as x from embeddings")
def vectors_to_parquet(spark, sf_dir):
    """Text vectors converted to Parquet and read from there."""
    path = _place(spark)
    rows = table(spark, sf_dir, "embeddings")
    rows.select(F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(f"{path}.txt")
    sinks.vectors_parquet(readers.word_vectors(spark, f"{path}.txt"), f"{path}.parquet")
    found = readers.word_vectors(spark, f"{path}.parquet")
    return doc_vectors.long_form(found.select("word", vx.doubles(F.col("vec")).alias("vec")), "word", decimals=6)


@query(f"with {_cooc_sql()} select i::int as i, j::int as j, x::float as x from cooc")
def cooc_parquet(spark, sf_dir):
    """Co-occurrences written as int, int, float and read back."""
    path = _place(spark)
    sinks.cooccurrence_parquet(cooc_weighted(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(f"with {_cooc_sql()} select i::int as i, j::int as j, x::float::double as x from cooc")
def cooc_records(spark, sf_dir):
    """Co-occurrences as 12-byte records, in blobs, unpacked again."""
    path = _place(spark)
    sinks.cooccurrence_binary(cooc_weighted(spark, sf_dir), path)
    return readers.blob_triples(spark, path)


@query(
    """with placed as (select conv_id, turn, row_number() over (order by conv_id, turn) - 1 as r, count(*) over () as n from conversations),
    own as (select conv_id, turn, (select max(k) from range(10) t(k) where (n * k) // 10 <= r)::int as shard from placed) select conv_id, turn from own where shard < 3"""
)
def sentence_shards(spark, sf_dir):
    """Three of ten shards of the turns."""
    path = _place(spark)
    rows = settle(counts.dense_ids(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.asc("conv_id"), F.asc("turn")], name="row_id"))
    sinks.sentence_shards(rows, rows.count(), 10, path)
    return readers.sentence_shards(spark, ", ".join(f"{path}/shard={k}" for k in range(3)), shuffle_seed=1).select("conv_id", "turn")


@query(f"select '__label__' || coalesce(role, 'none') || ' ' || {_FLAT} as value, count(*) as n from conversations group by all")
def sentence_dump(spark, sf_dir):
    """One labelled line a sentence."""
    path = _place(spark)
    sinks.sentences_text(table(spark, sf_dir, "conversations"), path, _flat(), F.coalesce("role", F.lit("none")))
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"select {_FLAT} as sentence, role as label, count(*) as n from conversations group by all")
def read_sentences(spark, sf_dir):
    """A CSV file with the header sentence,label."""
    path = _place(spark)
    rows = table(spark, sf_dir, "conversations").select(_flat().alias("sentence"), F.col("role").alias("label"))
    rows.write.options(**_WHOLE).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return readers.sst_sentences(spark, path).groupBy("sentence", "label").agg(F.count(F.lit(1)).alias("n"))
