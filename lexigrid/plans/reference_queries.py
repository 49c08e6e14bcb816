"""Queries over the driver's tables, each with its SQL where SQL can express it.

Word vectors come from `embeddings`: the word of rank r in the vocabulary of
`documents` has the vector with vec_id r; later words have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import batches
from lexigrid.functions import text as tx
from lexigrid.functions import vectors as vx
from lexigrid.operators import alignment, cooc, counts, doc_vectors, learning, sentences, training
from lexigrid.operators.runtime import settle

QUERIES: dict = {}
SQL: dict[str, str] = {}
MIN_COUNT = 5
DIM = 64


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _vocabulary(spark, sf_dir, min_count=MIN_COUNT):
    return counts.corpus_vocabulary(_docs(spark, sf_dir), min_count=min_count)


def _low_tokens():
    return tx.tokenize(F.lower(F.col("text")))


def _word_vectors(spark, sf_dir):
    """word, vec by rank among the white-space words of documents."""
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    ranked = counts.top_vocabulary(_docs(spark, sf_dir), (-1 if n is None else n) + 3, reserved=0)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("vec"))
    return ranked.join(vectors, "id").select("word", "vec")


# SQL fragments

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{tx.SPLIT_RX}')"
_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{tx.TOKEN_RX}')"


def _vocab_sql(min_count: int = MIN_COUNT, source: str = "documents") -> str:
    return f"""vocab as (select word, n as "count", (row_number() over (order by n desc, word) - 1)::bigint as id
        from (select word, count(*) as n from (select unnest({_WORDS}) as word from {source}) group by word having count(*) >= {min_count}))"""


_RANKED = _vocab_sql(1).replace("vocab as", "ranked as")
_VECTORS = f"""{_RANKED}, wordvec as (select word, embedding::double[] as vec from ranked join embeddings on id = vec_id)"""


def _cooc_sql(min_count: int = MIN_COUNT, window: int = 10) -> str:
    return f"""{_vocab_sql(min_count)},
    pos as (select doc_id, p, id from (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from (select doc_id, {_WORDS} as w from documents)) join vocab using (word)),
    pairs as (select least(a.id, b.id) as i, greatest(a.id, b.id) as j, a.p - b.p as d
        from (select *, unnest(range(1, {window} + 1)) as back from pos) a join pos b on a.doc_id = b.doc_id and b.p = a.p - a.back),
    cooc as (select i, j, sum(2520 // d)::double / 2520.0::double as x from pairs group by i, j)"""


# counts and vocabularies


@query(f"select feature, count(*) as \"count\" from (select unnest({_TOKENS}) as feature from documents) group by feature")
def tokenize_counts(spark, sf_dir):
    return counts.feature_counts(_docs(spark, sf_dir), _low_tokens())


@query(f"with {_vocab_sql()} select word, \"count\", id from vocab")
def vocab_ranked(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query(f"with {_vocab_sql(1)} select word, \"count\", id + 2 as id from vocab where id < 998")
def vocab_topn_ids(spark, sf_dir):
    return counts.top_vocabulary(_docs(spark, sf_dir), 1000, reserved=2)


@query(
    f"""select feature, n as "count", (row_number() over (order by feature) - 1)::bigint as id
    from (select feature, count(*) as n from (select unnest({_TOKENS}) as feature from documents) group by feature having count(*) >= 2)"""
)
def feature_vocab(spark, sf_dir):
    return counts.feature_vocabulary(_docs(spark, sf_dir), _low_tokens(), min_count=2)


@query(
    f"""with c as (select feature, count(*) as n from (select unnest({_TOKENS}) as feature from documents) group by feature)
    select feature, round(0.01::double * (select sum(n) from c)::double / (0.01::double * (select sum(n) from c)::double + n), 9) as weight from c"""
)
def sif_weights(spark, sf_dir):
    found = counts.sif_weights(counts.feature_counts(_docs(spark, sf_dir), _low_tokens()), 1e-2)
    return found.select("feature", F.round("weight", 9).alias("weight"))


@query(
    f"""with d as (select unnest({_TOKENS}) as word from documents), b as (select unnest({_TOKENS}) as word from benchmark)
    select distinct word from d where word in (select word from b)"""
)
def vocab_intersection(spark, sf_dir):
    words = lambda t: table(spark, sf_dir, t).select(F.explode(_low_tokens()).alias("word")).distinct()
    return words("documents").join(words("benchmark"), "word")


@query(f"select distinct word from (select unnest({_TOKENS}) as word from documents union all select unnest({_TOKENS}) as word from benchmark)")
def distinct_words(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return both.select(F.explode(_low_tokens()).alias("word")).distinct()


# co-occurrence


@query(f"with {_cooc_sql()} select i, j, x from cooc")
def cooc_weighted(spark, sf_dir, min_count=MIN_COUNT):
    return cooc.cooccurrence(_docs(spark, sf_dir), settle(_vocabulary(spark, sf_dir, min_count)))


@query(f"with {_cooc_sql()} select i, j, count(*)::double as x from pairs group by i, j")
def cooc_unweighted(spark, sf_dir):
    return cooc.cooccurrence(_docs(spark, sf_dir), settle(_vocabulary(spark, sf_dir)), unweighted=True)


@query(f"with {_cooc_sql()} select i, j, x from cooc union all select j as i, i as j, x from cooc where i < j")
def cooc_symmetric(spark, sf_dir):
    return cooc.symmetric(cooc_weighted(spark, sf_dir))


@query(f"with {_cooc_sql()}, halves as (select i, x from cooc union all select j as i, x from cooc where i < j) select i, round(sum(x), 6) as total from halves group by i")
def cooc_row_sums(spark, sf_dir):
    return cooc.row_totals(_docs(spark, sf_dir), settle(_vocabulary(spark, sf_dir))).select("i", F.round("total", 6).alias("total"))


@query(f"with {_cooc_sql()}, halves as (select i, x from cooc union all select j as i, x from cooc where i < j) select i, 2 * count(*) as n from halves group by i")
def cooc_nonzeros(spark, sf_dir):
    return cooc.nonzeros(cooc_weighted(spark, sf_dir))


@query(f"with {_cooc_sql()} select i, j, round(least(1.0::double, pow(x / 100.0::double, 0.75::double)), 9) as weight, round(ln(x), 9) + 0.0 as log_x from cooc")
def glove_weights(spark, sf_dir):
    found = cooc.weights(cooc_weighted(spark, sf_dir))
    return found.select("i", "j", F.round("weight", 9).alias("weight"), F.round("log_x", 9).alias("log_x"))


@query(f"with {_cooc_sql()} select i - 1 as i, j - 1 as j, x::float as x from cooc where i <= j")
def cooc_reformat(spark, sf_dir):
    return cooc.reformat(cooc.symmetric(cooc_weighted(spark, sf_dir)))


# bags

def _bag_sql(k: int, ordered: bool, min_count: int) -> str:
    words = ", ".join(["w", *(f"lead(w, {m}) over o" for m in range(1, k))])
    gram = "array_to_string(ws, ' ')" if ordered else "array_to_string(list_sort(ws), ' ')"
    return f"""with tok as (select doc_id, {_TOKENS} as t from documents), pos as (select doc_id, unnest(t) as w, unnest(range(len(t))) as p from tok),
    runs as (select doc_id, [{words}] as ws from pos window o as (partition by doc_id order by p)),
    g as (select doc_id, {gram} as feature from runs where ws[{k}] is not null),
    known as (select feature, (row_number() over (order by string_split(feature, ' ')) - 1)::bigint as feature_id from (select feature from g group by feature having count(*) >= {min_count}))
    select doc_id, feature_id, count(*) as "value" from g join known using (feature) group by doc_id, feature_id"""


def _bag(spark, sf_dir, k, ordered, min_count):
    counted = settle(counts.gram_counts(_docs(spark, sf_dir), k, ordered))
    return counts.bag(counted, counts.vocabulary_of(counted, min_count, order=[F.split("feature", " ")]))


for _k, _min in ((1, 1), (2, 2), (3, 2)):
    for _name, _ordered in (("bong", True), ("bonc", False)):

        def _made(spark, sf_dir, k=_k, ordered=_ordered, least=_min):
            return _bag(spark, sf_dir, k, ordered, least)

        _made.__name__ = f"{_name}_{_k}"
        query(_bag_sql(_k, _ordered, _min))(_made)


@query(
    f"""with tok as (select doc_id, {_TOKENS} as t from documents), g as (select doc_id, unnest(t) as feature from tok),
    c as (select feature, count(*) as n, (row_number() over (order by feature) - 1)::bigint as feature_id from g group by feature),
    total as (select 0.001::double * sum(n)::double as a from c)
    select doc_id, feature_id, round(count(*) * (any_value(a) / (any_value(a) + any_value(n))), 9) as "value" from g join c using (feature), total group by doc_id, feature_id"""
)
def bof_weighted(spark, sf_dir):
    counted = settle(counts.gram_counts(_docs(spark, sf_dir), 1))
    known = settle(counts.vocabulary_of(counted))
    out = counts.bag(counted, known, weights=counts.sif_weights(known, 1e-3))
    return out.select("doc_id", "feature_id", F.round("value", 9).alias("value"))


# document vectors

_DOC = """with {vectors}, tok as (select doc_id, {words} as t from documents), w as (select doc_id, unnest(t) as word from tok),
    s as (select doc_id, unnest(range(64)) as dim, unnest(vec) as x, n from (select doc_id, word, count(*) as n from w group by doc_id, word) join wordvec using (word)),
    summed as (select doc_id, dim, sum(n * x) as x from s group by doc_id, dim),
    every as (select doc_id, len(t) as size, unnest(range(64)) as dim from tok)"""


def _rounded(frame):
    return doc_vectors.long_form(frame, "doc_id", decimals=5)


@query(_DOC.format(vectors=_VECTORS, words=_WORDS) + " select doc_id, dim::int as dim, round(coalesce(x, 0), 5) + 0.0 as x from every left join summed using (doc_id, dim)")
def doc_sum(spark, sf_dir):
    return _rounded(doc_vectors.document_vectors(_docs(spark, sf_dir), F.col("text"), _word_vectors(spark, sf_dir), DIM, split=batches.words))


@query(_DOC.format(vectors=_VECTORS, words=_WORDS) + " select doc_id, dim::int as dim, round(coalesce(x, 0) / greatest(1, size), 5) + 0.0 as x from every left join summed using (doc_id, dim)")
def doc_avg(spark, sf_dir):
    return _rounded(doc_vectors.document_vectors(_docs(spark, sf_dir), F.col("text"), _word_vectors(spark, sf_dir), DIM, average=True, split=batches.words))


_SIF = _DOC.format(vectors=_VECTORS, words=_TOKENS).replace(
    "summed as (select doc_id, dim, sum(n * x) as x",
    "f as (select word, 0.01::double * (select count(*) from w)::double / (0.01::double * (select count(*) from w)::double + count(*)) as weight from w group by word), summed as (select doc_id, dim, sum(n * weight * x) as x",
).replace("unnest(vec) as x, n from", "unnest(vec) as x, n, weight from").replace("join wordvec using (word))", "join wordvec using (word) join f using (word))")
_at = _SIF.index("f as (select word")
_end = _SIF.index("summed as")
_SIF = _SIF.replace(_SIF[_at:_end], "").replace("    s as (select", "    " + _SIF[_at:_end] + "s as (select")


@query(_SIF + " select doc_id, dim::int as dim, round(coalesce(x, 0), 5) + 0.0 as x from every left join summed using (doc_id, dim)")
def doc_sif(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    weights = counts.sif_weights(counts.token_counts(docs), 1e-2).withColumnRenamed("feature", "word")
    return _rounded(doc_vectors.document_vectors(docs, F.lower(F.col("text")), _word_vectors(spark, sf_dir), DIM, weights=weights, split=batches.tokens))


def _disc_sql(composed: str) -> str:
    return f"""with {_VECTORS}, tok as (select doc_id, {_TOKENS} as t from documents),
    g as (select doc_id, a, b, count(*) as n from (select doc_id, unnest(t[1:len(t)-1]) as a, unnest(t[2:]) as b from tok where len(t) >= 2) group by doc_id, a, b),
    gv as (select a, b, {composed} as vec from (select distinct a, b from g) join (select word as a, vec as va from wordvec) using (a) join (select word as b, vec as vb from wordvec) using (b)),
    halves as (select doc_id, unnest(range(64)) as dim, unnest(vec) as x, n from g join gv using (a, b)),
    one as (select doc_id, unnest(range(64)) as dim, unnest(vec) as x, n from (select doc_id, word, count(*) as n from (select doc_id, unnest(t) as word from tok) group by doc_id, word) join wordvec using (word)),
    summed as (select doc_id, dim, sum(n * x) as x from one group by doc_id, dim union all select doc_id, dim + 64, sum(n * x) / 2.0::double from halves group by doc_id, dim),
    every as (select doc_id, unnest(range(128)) as dim from documents)
    select doc_id, dim::int as dim, round(coalesce(x, 0), 4) + 0.0 as x from every left join summed using (doc_id, dim)"""


def _disc(spark, sf_dir, composition):
    out = doc_vectors.composed_vectors(_docs(spark, sf_dir), _word_vectors(spark, sf_dir), 2, composition, DIM)
    return doc_vectors.long_form(out, "doc_id", decimals=4)


@query(_disc_sql("[va[k] * 8.0::double * vb[k] for k in range(1, 65)]"))
def disc_mult(spark, sf_dir):
    return _disc(spark, sf_dir, "mult")


@query(_disc_sql("[list_sum([va[m + 1] * vb[((z - m + 64) % 64) + 1] for m in range(0, 64)]) for z in range(0, 64)]"))
def disc_conv(spark, sf_dir):
    return _disc(spark, sf_dir, "conv")


@query("select vec_id, unnest(range(64))::int as dim, round(unnest(case when n > 0 then [x / n for x in v] else v end), 9) + 0.0 as x from (select vec_id, embedding::double[] as v, sqrt(list_sum([x * x for x in embedding::double[]])) as n from embeddings)")
def vector_unit_norm(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vx.unit(F.col("embedding")).alias("vec"))
    return doc_vectors.long_form(unit, "vec_id", decimals=9)


@query(
    f"""with {_VECTORS}, {_vocab_sql(1, "benchmark").replace("vocab as", "bench as")},
    source as (select word, embedding::double[] as vec from ranked join embeddings on id = vec_id),
    target as (select word, embedding::double[] as vec from bench join embeddings on id = vec_id)
    select word, round(list_dot_product(source.vec, target.vec) / (sqrt(list_dot_product(source.vec, source.vec)) * sqrt(list_dot_product(target.vec, target.vec))), 6) + 0.0 as cosine
    from source join target using (word)"""
)
def align_shared_vocab(spark, sf_dir):
    bench = counts.corpus_vocabulary(table(spark, sf_dir, "benchmark").select("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("vec"))
    pairs = doc_vectors.shared_vocabulary(_word_vectors(spark, sf_dir), bench.join(vectors, "id").select("word", "vec"))
    return pairs.select("word", F.round(vx.cosine(F.col("source"), F.col("target")), 6).alias("cosine"))


@query(
    f"""with {_VECTORS}, bench as (select distinct unnest({_WORDS}) as word from benchmark),
    mean as (select dim, avg(x) as x from (select unnest(range(64)) as dim, unnest(vec) as x from wordvec) group by dim),
    own as (select word, unnest(range(64)) as dim, unnest(vec) as x from wordvec)
    select word, dim::int as dim, round(coalesce(own.x, mean.x), 6) + 0.0 as x from bench cross join mean left join own using (word, dim)"""
)
def align_params_mean(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.explode(tx.split_words(F.col("text"))).alias("word")).distinct()
    out = doc_vectors.align_parameters(settle(_word_vectors(spark, sf_dir)), bench)
    return doc_vectors.long_form(out, "word", decimals=6)


@query(
    """with c as (select label, dim, avg(x) as m from (select label, unnest(range(64)) as dim, unnest(embedding::double[]) as x from embeddings) group by label, dim),
    v as (select vec_id, unnest(range(64)) as dim, unnest(embedding::double[]) as x from embeddings),
    far as (select vec_id, c.label, round(sum((x - m) * (x - m)), 9) as d from v join c using (dim) group by vec_id, c.label)
    select vec_id, arg_min(label, (d, label)) as prediction from far group by vec_id"""
)
def centroid_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", vx.doubles(F.col("embedding")).alias("vec"))
    return learning.nearest_centroid(rows, settle(learning.centroids(rows)), "vec_id")


# sentences: a conversation is a file, a turn is a line


@query(
    f"""with own as (select conv_id, turn, {_WORDS} as t from conversations),
    three as (select conv_id, turn, lag(t) over w as pre, t as cur, lead(t) over w as post from own window w as (partition by conv_id order by turn))
    select conv_id, turn, array_to_string(pre, ' ') as pre, array_to_string(cur, ' ') as "current", array_to_string(post, ' ') as post from three
    where coalesce(len(pre) > 0 and len(cur) > 0 and len(post) > 0, false) and len(pre) < 30 and len(cur) < 30 and len(post) < 30"""
)
def sentence_triples(spark, sf_dir):
    found = sentences.triples(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return found.select("conv_id", "turn", *[tx.gram_text(F.col(c)).alias(c) for c in ("pre", "current", "post")])


@query(
    f"""with own as (select conv_id, turn, {_WORDS} as t from conversations),
    three as (select lag(t) over w as pre, t as cur, lead(t) over w as post from own window w as (partition by conv_id order by turn)),
    judged as (select coalesce(len(pre) > 0 and len(cur) > 0 and len(post) > 0, false) as considered, coalesce(greatest(len(pre), len(cur), len(post)) >= 30, false) as long from three)
    select count(*) as seen, count(*) filter (where considered) as considered, count(*) filter (where considered and long) as too_long, count(*) filter (where considered and not long) as "output" from judged"""
)
def sentence_stats(spark, sf_dir):
    return sentences.triple_stats(sentences.judged_triples(table(spark, sf_dir, "conversations"), "conv_id", "turn"))


@query(
    f"""with {_vocab_sql(1, "conversations")}, known as (select word, id + 1 as id from vocab where id < 998),
    own as (select conv_id, turn, [lower(x) for x in {_WORDS}[1:30]] as t from conversations),
    tok as (select conv_id, turn, unnest(t) as word, unnest(range(len(t))) as p from own)
    select conv_id, turn, coalesce(ids, '') as ids from own left join (select conv_id, turn, string_agg(coalesce(id, 0)::varchar, ' ' order by p) as ids from tok left join known using (word) group by conv_id, turn) using (conv_id, turn)"""
)
def sentence_ids_truncated(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    known = counts.top_vocabulary(rows, 1000, reserved=1)
    out = sentences.encode(rows, ["conv_id", "turn"], sentences.truncate(tx.split_words(F.col("text"))), known, unknown=0, lower=True)
    return out.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _pairs(spark, sf_dir):
    """conv_id, turn, x, y: sums of the vectors of a turn's words and of the next turn's."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    keyed = rows.withColumn("key", F.struct("conv_id", "turn"))
    vecs = doc_vectors.document_vectors(keyed, F.col("text"), _word_vectors(spark, sf_dir), DIM, id_col="key", split=batches.words)
    own = settle(vecs.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "vec"))
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("vec").alias("y"))
    return own.withColumnRenamed("vec", "x").join(after, ["conv_id", "turn"])


_PAIR = f"""with {_VECTORS}, tok as (select conv_id, turn, {_WORDS} as t from conversations),
    s as (select conv_id, turn, unnest(range(64)) as dim, unnest(vec) as x from (select conv_id, turn, unnest(t) as word from tok) join wordvec using (word)),
    v as (select conv_id, turn, dim, coalesce(sum(x), 0) as x from (select conv_id, turn, unnest(range(64)) as dim from tok) left join s using (conv_id, turn, dim) group by conv_id, turn, dim),
    pair as (select a.conv_id, a.turn, dim, a.x, b.x as y from v a join (select conv_id, turn - 1 as turn, dim, x from v) b using (conv_id, turn, dim))"""


@query(_PAIR + " select conv_id, turn, round(case when sum(x * x) > 0 and sum(y * y) > 0 then sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) else 0 end, 6) + 0.0 as cosine from pair group by conv_id, turn")
def pair_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(vx.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(_PAIR + " select conv_id, turn, dim::int as dim, round(abs(x - y), 5) + 0.0 as x from pair union all select conv_id, turn, (dim + 64)::int, round(x * y, 4) + 0.0 from pair")
def pair_features(spark, sf_dir):
    both = _pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(vx.pair_features(F.col("x"), F.col("y"))).alias("dim", "x"))
    return both.select("conv_id", "turn", "dim", F.when(F.col("dim") < DIM, F.round("x", 5)).otherwise(F.round("x", 4)).alias("x"))


@query(
    """with b as (select vec_id // 50 as batch, vec_id % 50 as pos, embedding::double[] as v from embeddings),
    s as (select l.batch, l.pos as p, r.pos as q, case when l.pos = r.pos then 0 else list_dot_product(l.v, r.v) end as score, abs(l.pos - r.pos) between 1 and 1 as target from b l join b r using (batch))
    select batch, p, q, round(score, 6) + 0.0 as score, target from s"""
)
def inbatch_context_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("batch"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding").alias("left_vec"), F.col("embedding").alias("right_vec"))
    return sentences.context_scores(rows).withColumn("score", F.round("score", 6))


@query(
    f"""select page_id, regexp_replace(url, '{tx.URL_RX}', '<url>', 'g') as url,
    regexp_replace(regexp_replace(html, '{tx.URL_RX}', '<url>', 'g'), '{tx.USER_RX}', '<user>', 'g') as html from pages"""
)
def mask_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.mask_urls(F.col("url")).alias("url"), tx.mask_users(tx.mask_urls(F.col("html"))).alias("html"))


@query("select doc_id, split_part(lang || ':' || source, ':', 1) as label from documents")
def coarse_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.label_prefix(F.concat_ws(":", "lang", "source")).alias("label"))


@query("select doc_id, quality, toxic, ((row_number() over (partition by quality order by doc_id) - 1) % 10)::int as fold from labels")
def stratified_folds(spark, sf_dir):
    return learning.exact_folds(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), 10, "quality")


@query(
    """with r as (select n_chars::double as x, quality::double as y from documents join labels using (doc_id)),
    k as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry from r)
    select round(100 * corr(x, y), 6) as pearson, round(100 * corr(rx, ry), 6) as spearman from k"""
)
def length_quality_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return learning.correlations(rows, "x", "y").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(
    f"""with {_vocab_sql(1, "benchmark").replace("vocab as", "bench as")}, {_VECTORS},
    unit as (select word, [x / sqrt(list_dot_product(vec, vec)) for x in vec] as vec from wordvec)
    select id, unnest(range(64))::int as dim, round(unnest(coalesce(vec, list_resize([0.0::double], 64, 0.0::double))), 9) + 0.0 as x from bench left join unit using (word)"""
)
def vocabulary_matrix(spark, sf_dir):
    bench = counts.corpus_vocabulary(table(spark, sf_dir, "benchmark").select("text"))
    return doc_vectors.long_form(doc_vectors.vocabulary_matrix(bench, _word_vectors(spark, sf_dir), DIM), "id", decimals=9)


@query(
    f"""with {_VECTORS}, {_vocab_sql(1, "benchmark").replace("vocab as", "bench as")},
    pair as (select s.vec as x, embedding::double[] as y from bench join wordvec s using (word) join embeddings on id = vec_id)
    select round(avg(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))), 9) + 0.0 as cosine from pair"""
)
def mean_cosine(spark, sf_dir):
    bench = counts.corpus_vocabulary(table(spark, sf_dir, "benchmark").select("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("vec"))
    pairs = doc_vectors.shared_vocabulary(_word_vectors(spark, sf_dir), bench.join(vectors, "id").select("word", "vec"))
    return doc_vectors.average_cosine(pairs).select(F.round("cosine", 9).alias("cosine"))


@query(
    f"""with {_cooc_sql()}, {_RANKED}, own as (select vocab.id, embedding::double[] as vec from vocab join ranked using (word) join embeddings on ranked.id = vec_id),
    halves as (select i, j, x from cooc union all select j, i, x from cooc where i < j),
    total as (select i, sum(x) as total from halves group by i),
    s as (select i, unnest(range(64)) as dim, unnest(vec) * x as x from halves join own on j = id)
    select i, dim::int as dim, round(sum(x) / any_value(total), 6) + 0.0 as x from s join total using (i) group by i, dim"""
)
def context_vectors(spark, sf_dir):
    vocabulary = settle(_vocabulary(spark, sf_dir))
    vectors = settle(_word_vectors(spark, sf_dir).join(vocabulary.select("word", "id"), "word").select("id", "vec"))
    return doc_vectors.long_form(alignment.corpus_context_vectors(_docs(spark, sf_dir), vocabulary, vectors), "i", decimals=6)


_PLAIN = "case x " + " ".join(f"when '{code}' then '{sign}'" for code, sign in tx.UNESCAPES.items()) + " else x end"


@query(
    f"""select conv_id, turn, regexp_replace(regexp_replace(lower(array_to_string([{_PLAIN} for x in {_WORDS}], ' ')), '{tx.URL_RX}', '<url>', 'g'), '{tx.USER_RX}', '<user>', 'g') as text from conversations"""
)
def normalized_sentences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.normalize_sentence(F.coalesce("text", F.lit(""))).alias("text"))


@query(
    f"""with {_vocab_sql(1, "conversations")}, known as (select word, id + 2 as id from vocab where id < 998),
    own as (select conv_id, turn, {_WORDS} as t from conversations),
    tok as (select conv_id, turn, unnest(t) as word, unnest(range(len(t))) as p from own),
    enc as (select conv_id, turn, list_append(coalesce(ids, []), 0) as ids from own left join (select conv_id, turn, list(coalesce(id, 1) order by p) as ids from tok left join known using (word) group by conv_id, turn) using (conv_id, turn)),
    placed as (select *, (row_number() over (order by conv_id, turn) - 1) // 128 as batch from enc),
    sized as (select *, max(len(ids)) over (partition by batch) as longest from placed)
    select conv_id, turn, batch::bigint as batch, array_to_string(list_resize(ids, longest, 0), ' ') as ids, array_to_string(list_resize([1 for x in ids], longest, 0), ' ') as mask from sized"""
)
def padded_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    known = counts.top_vocabulary(rows, 1000, reserved=2)
    encoded = sentences.encode(rows, ["conv_id", "turn"], tx.split_words(F.col("text")), known, eos=sentences.EOS)
    out = sentences.padded_batches(encoded, [F.asc("conv_id"), F.asc("turn")], 128)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("conv_id", "turn", "batch", flat("ids"), flat("mask"))


@query(
    """with placed as (select conv_id, turn, row_number() over (order by conv_id, turn) - 1 as r, count(*) over () as n from conversations)
    select conv_id, turn, (select max(k) from range(10) t(k) where (n * k) // 10 <= r)::int as shard from placed"""
)
def shard_numbers(spark, sf_dir):
    rows = counts.dense_ids(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.asc("conv_id"), F.asc("turn")], name="row_id")
    return sentences.with_shards(rows, rows.count(), 10).drop("row_id")


@query("select conv_id, turn, case when row_number() over (order by conv_id, turn) <= 100 then 'validation' else 'train' end as split from conversations")
def head_tail_split(spark, sf_dir):
    return sentences.head_tail_split(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.asc("conv_id"), F.asc("turn")], 100)


@query(
    """with b as (select vec_id // 50 as batch, vec_id % 50 as pos, embedding::double[] as v from embeddings),
    s as (select l.batch, l.pos as p, r.pos as q, case when l.pos = r.pos then 0 else list_dot_product(l.v, r.v) end as score from b l join b r using (batch)),
    best as (select batch, p, arg_max(q, (score, -q)) as best, max(q) as last from s group by batch, p)
    select round(avg(case when p < last then (best = p + 1)::int::double end), 9) as forward, round(avg(case when p > 0 then (best = p - 1)::int::double end), 9) as backward from best"""
)
def retrieval_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("batch"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding").alias("left_vec"), F.col("embedding").alias("right_vec"))
    return sentences.retrieval_accuracy(sentences.context_scores(rows)).select(F.round("forward", 9).alias("forward"), F.round("backward", 9).alias("backward"))


@query(
    """with r as (select (n_chars > 2000)::int as p, quality as y from documents join labels using (doc_id)),
    k as (select count(*) filter (where p = y) as hit, count(*) as n, count(*) filter (where p = 1 and y = 1) as tp, count(*) filter (where (p = 1) <> (y = 1)) as wrong from r)
    select round(100.0::double * hit / n, 9) as accuracy, round(200.0::double * tp / (2 * tp + wrong), 9) as f1 from k"""
)
def accuracy_and_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("prediction")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    both = learning.accuracy(rows).crossJoin(learning.f1(rows))  # one row each
    return both.select(F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


# fitted models: no SQL


@query()
def classifier_metrics(spark, sf_dir):
    """Toxicity from word-vector sums: nearest centroid over ten folds."""
    from lexigrid.operators.representations import WeightedSum

    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    scores = learning.evaluate("folds", {"all": rows}, WeightedSum(settle(_word_vectors(spark, sf_dir)), DIM), learning.Centroid, folds=10)
    return spark.range(1).select(F.lit(scores["train"]).alias("train_accuracy"), F.lit(scores["test"]).alias("test_accuracy"))


@query()
def glove_train(spark, sf_dir):
    """Loss of each of three epochs of GloVe, 8 places."""
    vocabulary = settle(_vocabulary(spark, sf_dir))
    found = settle(cooc.cooccurrence(_docs(spark, sf_dir), vocabulary))
    trainer = training.WordVectorTrainer(8, epochs=3)
    trainer.fit(found, vocabulary.count())
    return spark.range(len(trainer.losses)).select((F.col("id") + 1).alias("epoch"), F.element_at(F.array(*[F.lit(x) for x in trainer.losses]), (F.col("id") + 1).cast("int")).alias("loss"))


@query()
def procrustes(spark, sf_dir):
    """How well each kind of map takes each word's vector to that of the next word."""
    vectors = settle(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), vx.doubles(F.col("embedding")).alias("vec")))
    after = vectors.select((F.col("word").cast("long") - 1).cast("string").alias("word"), "vec")
    rows = [(o, i, alignment.linear_alignment(vectors, after, o, i)) for o in (True, False) for i in (False, True)]
    return spark.createDataFrame(rows, "orthogonal boolean, intercept boolean, cosine double")


@query()
def induce(spark, sf_dir):
    """Vectors of the benchmark's words induced from their contexts, in long form."""
    source, bench = settle(_vocabulary(spark, sf_dir)), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    target = settle(counts.corpus_vocabulary(bench))
    vectors = settle(_word_vectors(spark, sf_dir).join(source.select("word", "id"), "word").select("id", "vec"))
    contexts = alignment.corpus_context_vectors(_docs(spark, sf_dir), source, vectors, only=vectors)
    out = alignment.induce_embeddings(source, None, vectors, target, settle(cooc.cooccurrence(bench, target)), contexts)
    return doc_vectors.long_form(out, "id", decimals=6)
