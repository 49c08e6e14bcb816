"""Queries of fitted maps and models, of the reference's remaining filters and functions; in two dimensions where SQL has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as tx
from lexigrid.functions import vectors as vx
from lexigrid.operators import alignment, cooc, counts, doc_vectors, learning, sentences, training
from lexigrid.operators.representations import BagOfGrams, WeightedSum
from lexigrid.operators.runtime import settle
from lexigrid.plans.reference_queries import _TOKENS, _cooc_sql, _docs, _vocabulary, _word_vectors, DIM, query, table

# linear maps between the first and the next two places of each vector

_FLAT_PAIRS = "p as (select vec_id, embedding[1]::double as x1, embedding[2]::double as x2, embedding[3]::double as y1, embedding[4]::double as y2 from embeddings)"
_LEAST_SQUARES = """solved as (select (c11 * s22 - c21 * s12) / det as m11, (c21 * s11 - c11 * s12) / det as m12, (c12 * s22 - c22 * s12) / det as m21, (c22 * s11 - c12 * s12) / det as m22
        from (select *, s11 * s22 - s12 * s12 as det from g))"""


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("v"))
    return settle(rows.select("vec_id", F.slice("v", 1, 2).alias("source"), F.slice("v", 3, 2).alias("target")))


def _mapped(spark, sf_dir, orthogonal, intercept):
    pairs = _pairs(spark, sf_dir)
    m, b = alignment.fit_transform(pairs, orthogonal, intercept)
    out = alignment.apply_transform(pairs.select("vec_id", F.col("source").alias("vec")), m, b)
    return doc_vectors.long_form(out, "vec_id", decimals=6)


def _map_sql(solved: str, shift: str = "0, 0") -> str:
    b1, b2 = shift.split(", ")
    return f"""with {_FLAT_PAIRS}, {solved}
    select vec_id, 0::int as dim, round(m11 * x1 + m12 * x2 + {b1}, 6) + 0.0 as x from p, solved union all select vec_id, 1::int, round(m21 * x1 + m22 * x2 + {b2}, 6) + 0.0 from p, solved"""


@query(_map_sql("g as (select sum(x1 * x1) s11, sum(x1 * x2) s12, sum(x2 * x2) s22, sum(x1 * y1) c11, sum(x2 * y1) c21, sum(x1 * y2) c12, sum(x2 * y2) c22 from p), " + _LEAST_SQUARES))
def least_squares_map(spark, sf_dir):
    return _mapped(spark, sf_dir, False, False)


@query(
    _map_sql(
        """means as (select avg(x1) a1, avg(x2) a2, avg(y1) t1, avg(y2) t2 from p),
    g as (select sum((x1 - a1) * (x1 - a1)) s11, sum((x1 - a1) * (x2 - a2)) s12, sum((x2 - a2) * (x2 - a2)) s22, sum((x1 - a1) * (y1 - t1)) c11, sum((x2 - a2) * (y1 - t1)) c21, sum((x1 - a1) * (y2 - t2)) c12, sum((x2 - a2) * (y2 - t2)) c22 from p, means), """
        + _LEAST_SQUARES.replace("solved as", "slopes as")
        + ", solved as (select *, t1 - m11 * a1 - m12 * a2 as b1, t2 - m21 * a1 - m22 * a2 as b2 from slopes, means)",
        "b1, b2",
    )
)
def least_squares_map_shifted(spark, sf_dir):
    return _mapped(spark, sf_dir, False, True)


@query(
    _map_sql(
        """g as (select sum(y1 * x1) c11, sum(y1 * x2) c12, sum(y2 * x1) c21, sum(y2 * x2) c22 from p),
    turned as (select *, hypot(c11 + c22, c21 - c12) >= hypot(c11 - c22, c21 + c12) as turn, atan2(c21 - c12, c11 + c22) as a, atan2(c21 + c12, c11 - c22) as f from (select *, sqrt(0.0) as z from g)),
    solved as (select case when turn then cos(a) else cos(f) end as m11, case when turn then -sin(a) else sin(f) end as m12, case when turn then sin(a) else sin(f) end as m21, case when turn then cos(a) else -cos(f) end as m22 from turned)""".replace(
            "hypot(c11 + c22, c21 - c12)", "sqrt((c11 + c22) * (c11 + c22) + (c21 - c12) * (c21 - c12))"
        ).replace("hypot(c11 - c22, c21 + c12)", "sqrt((c11 - c22) * (c11 - c22) + (c21 + c12) * (c21 + c12))").replace("from (select *, sqrt(0.0) as z from g)", "from g")
    )
)
def orthogonal_map(spark, sf_dir):
    return _mapped(spark, sf_dir, True, False)


# words w<n> have the two first places of vector n, the model has those of label 0; those with an underscore are no words
_EXPANDED = """source as (select case when vec_id % 5 = 0 then 'w_' || vec_id else 'w' || vec_id end as word, embedding[1]::double as x1, embedding[2]::double as x2 from embeddings),
    model as (select case when vec_id % 5 = 0 then 'w_' || vec_id else 'w' || vec_id end as word, embedding[3]::double as y1, embedding[4]::double as y2 from embeddings where label = 0),
    p as (select * from source join model using (word)), means as (select avg(x1) a1, avg(x2) a2, avg(y1) t1, avg(y2) t2 from p),
    g as (select sum((x1 - a1) * (x1 - a1)) s11, sum((x1 - a1) * (x2 - a2)) s12, sum((x2 - a2) * (x2 - a2)) s22, sum((x1 - a1) * (y1 - t1)) c11, sum((x2 - a2) * (y1 - t1)) c21, sum((x1 - a1) * (y2 - t2)) c12, sum((x2 - a2) * (y2 - t2)) c22 from p, means), """ + _LEAST_SQUARES.replace(
    "solved as", "slopes as"
)


@query(
    f"""with {_EXPANDED}, mapped as (select word, t1 + m11 * (x1 - a1) + m12 * (x2 - a2) as z1, t2 + m21 * (x1 - a1) + m22 * (x2 - a2) as z2 from source, slopes, means where not contains(word, '_')),
    every as (select word, coalesce(y1, z1) as v1, coalesce(y2, z2) as v2 from model full join mapped using (word))
    select word, 0::int as dim, round(v1, 6) + 0.0 as x from every union all select word, 1::int, round(v2, 6) + 0.0 from every"""
)
def vocabulary_expansion(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("w_"), F.col("vec_id"))).otherwise(F.concat(F.lit("w"), F.col("vec_id"))).alias("word"), vx.doubles(F.col("embedding")).alias("v"))
    rows = settle(rows)
    model = rows.where("label = 0").select("word", F.slice("v", 3, 2).alias("vec"))
    return doc_vectors.long_form(alignment.expand_vocabulary(model, rows.select("word", F.slice("v", 1, 2).alias("vec"))), "word", decimals=6)


@query(
    """with r as (select n_chars::double as x, quality::double as y from documents join labels using (doc_id) where n_chars is not null),
    m as (select avg(x) ax, avg(y) ay, count(*) n, sum(x * x) - count(*) * avg(x) * avg(x) sxx, sum(x * y) - count(*) * avg(x) * avg(y) sxy from r),
    a as (select unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double as alpha),
    e as (select alpha, sum(pow((y - ay - (x - ax) * sxy / (sxx + alpha)) / (1 - 1.0 / n - (x - ax) * (x - ax) / (sxx + alpha)), 2)) as loss from r, m, a group by alpha),
    best as (select alpha from e order by round(loss, 9), alpha limit 1)
    select round(1e6 * sxy / (sxx + alpha), 6) as slope, round(ay - ax * sxy / (sxx + alpha), 6) as intercept from m, best"""
)
def ridge_fit(spark, sf_dir):
    """Quality by length: ridge regression, its penalty by leaving one out."""
    rows = table(spark, sf_dir, "documents").where("n_chars is not null").join(table(spark, sf_dir, "labels"), "doc_id").select(F.array(F.col("n_chars").cast("double")).alias("features"), F.col("quality").cast("double").alias("label"))
    w, b, _ = learning.ridge(rows)
    return spark.range(1).select(F.round(F.lit(1e6 * float(w[0])), 6).alias("slope"), F.round(F.lit(float(b)), 6).alias("intercept"))


# training


@query(
    f"""with {_cooc_sql()}, s as (select vec_id as id, embedding::double[] as v from embeddings), halves as (select i, j, x from cooc union all select j, i, x from cooc where i < j),
    scored as (select least(1.0::double, pow(x / 100.0::double, 0.75::double)) as weight, list_dot_product(a.v[1:31], b.v[32:62]) + a.v[63] + b.v[64] - ln(x) as error from halves join s a on i = a.id join s b on j = b.id)
    select round(avg(weight * error * error), 6) as loss from scored"""
)
def glove_loss(spark, sf_dir):
    """The loss of given parameters: 31 places a vector and two biases from each embedding, over the words that have one."""
    state = settle(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("state")))
    known = settle(_vocabulary(spark, sf_dir).join(state.select("id"), "id", "left_semi"))  # other words keep their places and pair with none
    found = cooc.cooccurrence(_docs(spark, sf_dir), known)
    return training.loss(found, state, 31).select(F.round("loss", 6).alias("loss"))


@query()
def train_variants(spark, sf_dir):
    """Loss of an epoch of each other kind of training, 4 places; tests/test_operators.py holds steps against one-by-one loops."""
    vocabulary = settle(_vocabulary(spark, sf_dir))
    found, words = settle(cooc.cooccurrence(_docs(spark, sf_dir), vocabulary)), vocabulary.count()
    source = settle(doc_vectors.random_matrix(vocabulary, 4, seed=3))
    rows = []
    for name, model, method, pull in (("glove_sgd", "glove", "sgd", None), ("sn", "sn", "adagrad", None), ("glove_regularised", "glove", "adagrad", source), ("sn_regularised", "sn", "adagrad", source)):
        trainer = training.WordVectorTrainer(4, model, method, epochs=1, source=pull)
        trainer.fit(found, words)
        rows += [(name, k, float(x)) for k, x in enumerate(trainer.losses, 1)]
    return spark.createDataFrame(rows, "model string, epoch int, loss double")


@query()
def logistic_metrics(spark, sf_dir):
    """Toxicity from word-vector sums: logistic regression, C by cross-validation, trained on even documents and tested on odd ones; tests/test_operators.py tests the harness."""
    rows = settle(_docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id"))
    data = {"train": rows.where("doc_id % 2 = 0"), "test": rows.where("doc_id % 2 = 1")}
    scores = learning.evaluate("split", data, WeightedSum(settle(_word_vectors(spark, sf_dir)), DIM, average=True))
    return spark.range(1).select(F.lit(scores["train"]).alias("train_accuracy"), F.lit(scores["test"]).alias("test_accuracy"))


# bags of all lengths together, filters, splits, functions


@query(
    f"""with tok as (select doc_id, {_TOKENS} as t from documents), one as (select doc_id, unnest(t) as feature from tok), two as (select doc_id, unnest(t[1:len(t)-1]) || ' ' || unnest(t[2:]) as feature from tok where len(t) >= 2),
    k1 as (select feature, (row_number() over (order by feature) - 1)::bigint as feature_id from (select feature from one group by feature having count(*) >= 2)),
    k2 as (select feature, (row_number() over (order by string_split(feature, ' ')) - 1)::bigint + (select count(*) from k1) as feature_id from (select feature from two group by feature having count(*) >= 2))
    select doc_id, feature_id, count(*) as "value" from (select doc_id, feature_id from one join k1 using (feature) union all select doc_id, feature_id from two join k2 using (feature)) group by doc_id, feature_id"""
)
def bong_all(spark, sf_dir):
    """Single tokens and pairs in one space, ids of pairs after those of tokens."""
    docs = _docs(spark, sf_dir)
    return BagOfGrams(2, min_count=2).fit(docs).transform(docs)


@query(
    """with bench as (select distinct vec_id from embeddings where label = 1)
    select 'v' || vec_id as word, unnest(range(64))::int as dim, round(unnest([x / sqrt(list_dot_product(embedding::double[], embedding::double[])) for x in embedding::double[]]), 9) + 0.0 as x from embeddings where vec_id in (select vec_id from bench)"""
)
def vocabulary_vectors(spark, sf_dir):
    """Unit vectors of the words that a vocabulary has."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec"), "label")
    return doc_vectors.long_form(doc_vectors.vocabulary_vectors(rows.where("label = 1").select("word"), rows.select("word", "vec")), "word", decimals=9)


@query("select conv_id, turn, case when row_number() over (order by md5('123:' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) <= 100 then 'validation' else 'train' end as split from conversations")
def seeded_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return sentences.permuted_split(rows, "key", 100).select("conv_id", "turn", "split")


@query("select conv_id, turn from (select conv_id, turn, row_number() over (order by conv_id, turn) as r from conversations) where r <= 50")
def first_sentences(spark, sf_dir):
    return sentences.first_sentences(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.asc("conv_id"), F.asc("turn")], 50)


@query("select doc_id, quality from (select doc_id, quality, (row_number() over (partition by quality order by doc_id) - 1) % 10 as fold from labels) where fold <> 3")
def fold_training_rows(spark, sf_dir):
    return learning.exact_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), 10, "quality").where("fold <> 3").select("doc_id", "quality")


@query(
    """select vec_id, unnest(range(4))::int as dim, unnest([case when vec_id % 3 = 0 then 0.0::double else embedding[1]::double end, 1.7976931348623157e308::double, -1.7976931348623157e308::double, embedding[2]::double]) + 0.0 as x,
    ((vec_id + 63) // 64 * 64)::bigint as width from embeddings"""
)
def finite_and_rounded(spark, sf_dir):
    """NaN to 0 and infinities to the largest numbers; lengths rounded up to 64."""
    bad = F.array(F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("embedding")[0].cast("double")), F.lit(float("inf")), F.lit(float("-inf")), F.col("embedding")[1].cast("double"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", vx.nan_to_zero(bad).alias("v"), tx.ceil_to_step(F.col("vec_id"), 64).alias("width"))
    return out.select("vec_id", F.posexplode("v").alias("dim", "x"), "width")


@query(
    f"""with t as (select conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), ' ') as e, text from conversations)
    select conv_id, turn, sha256(encode(chr(10) || ' ' || regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^[{tx.WS}]+|[{tx.WS}]+$', '', 'g') || ' ')) as sha from t"""
)
def byte_input(spark, sf_dir):
    """Entities undone and padded, as UTF-8, of texts whose `&` and `<` are written as entities."""
    coded = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(tx.utf8_bytes(coded), 256).alias("sha"))


@query("select doc_id, regexp_replace(strip_accents(coalesce(text, '')), '[^\\x{00}-\\x{7F}]', '', 'g') as text from documents")
def ascii_folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.ascii_fold(F.coalesce("text", F.lit(""))).alias("text"))
