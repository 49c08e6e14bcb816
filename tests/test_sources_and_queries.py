import os
import struct

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import counts
from lexigrid.plans import file_queries, fitted_queries  # noqa: F401  they add their queries
from lexigrid.plans import reference_queries as rq
from lexigrid.sources import readers, sinks
from lexigrid.streaming import word_count


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_files(spark, tmp_path):
    trec = write(tmp_path / "trec_test.csv", 'HUM:ind\tWho is "it" ?\nLOC:other\tWhere ?\n')
    got = [tuple(r) for r in readers.labelled(spark, trec, split_label=True).collect()]
    assert got == [("HUM", 'Who is "it" ?'), ("LOC", "Where ?")]
    assert readers.trec(spark, str(tmp_path), ("test",))["test"].count() == 2
    for name, text in (("custrev.neg", "bad\n\n worse \n"), ("custrev.pos", "good\n")):
        write(tmp_path / name, text)
    assert [tuple(r) for r in readers.cr(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "bad", 0), (1, "", 0), (2, "worse", 0), (3, "good", 1)]
    db = write(tmp_path / "dbpedia_train.csv", '1,"A, title","Some ""text"""\n')
    assert [tuple(r) for r in readers.dbpedia(spark, str(tmp_path), ("train",))["train"].collect()] == [("1", 'Some "text"')] and db


def test_pairs(spark, tmp_path):
    s = write(tmp_path / "sick", "pair_ID\tsentence_A\tsentence_B\trelatedness_score\tentailment_judgment\n1\ta b\tc\t4.5\tNEUTRAL\n")
    assert tuple(readers.sick(spark, s).first()) == ("a b", "c", "NEUTRAL") and readers.sick(spark, s, True).first()["label"] == 4.5
    m = write(tmp_path / "mrpc", 'Quality\t#1\t#2\ta\tb\n1\t2\t3\tan "x\tother\n')
    assert [tuple(r) for r in readers.mrpc(spark, m).collect()] == [('an "x', "other", "1")]
    t = write(tmp_path / "sts", 'g\tf\ty\t0\t3.2\tfirst "q\tsecond\n')
    assert tuple(readers.sts(spark, t).first()) == ('first "q', "second", "3.2")


def test_vectors_and_vocabularies(spark, tmp_path):
    v = write(tmp_path / "v.txt", "a 1 2 3\nb 4 5 6 \nc 7 8 9\n")
    assert {r["word"]: r["vec"] for r in readers.word_vectors(spark, v, first=2, dimension=2).collect()} == {"a": [1.0, 2.0], "b": [4.0, 5.0]}
    words = spark.createDataFrame([("c",), ("z",)], "word string")
    assert [tuple(r) for r in readers.word_vectors(spark, v, words).collect()] == [("c", [7.0, 8.0, 9.0])]
    sinks.vectors_parquet(readers.word_vectors(spark, v), str(tmp_path / "v.parquet"))
    assert readers.word_vectors(spark, str(tmp_path / "v.parquet"), words).count() == 1
    f = write(tmp_path / "vocab.txt", "b 3\na 2\nb 1\n")
    assert {r["word"]: r["id"] for r in readers.vocabulary_file(spark, f, "last").collect()} == {"b": 2, "a": 1}
    with pytest.raises(ValueError):
        readers.vocabulary_file(spark, f)
    vocab = counts.corpus_vocabulary(spark.createDataFrame([(0, "b b a")], "doc_id long, text string"))
    sinks.vocabulary_text(vocab, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["b 2", "a 1"]


def test_binary_triples_come_back(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(b"".join(struct.pack("<iif", i, i + 1, i / 2) for i in range(1000)))
    got = sorted(tuple(r) for r in readers.binary_triples(spark, str(tmp_path / "c.bin")).collect())
    assert got == [(i, i + 1, i / 2) for i in range(1000)]
    (tmp_path / "w.bin").write_bytes(struct.pack("<iid", 1, 2, 0.1))
    assert tuple(readers.binary_triples(spark, str(tmp_path / "w.bin"), wide=True).first()) == (1, 2, 0.1)


def test_shards(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    sinks.sentence_shards(rows, 10, 3, str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if d.startswith("shard")) == ["shard=0", "shard=1", "shard=2"]
    assert readers.sentence_shards(spark, f"{tmp_path}/s/shard=0, {tmp_path}/s/shard=1", 1).count() == 6


def test_streamed_counts(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    write(tmp_path / "in" / "a.txt", "a b a\n")
    stream = spark.readStream.schema("text string").format("text").load(str(tmp_path / "in")).select(F.col("text"))
    q = word_count.word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
        write(tmp_path / "in" / "b.txt", "b c\n")
        q.processAllAvailable()
        assert {r["word"]: r["count"] for r in spark.table("streamed").collect()} == {"a": 2, "b": 2, "c": 1}
    finally:
        q.stop()


FAST = ["tokenize_counts", "vocab_ranked", "vocab_topn_ids", "feature_vocab", "cooc_weighted", "cooc_nonzeros", "bonc_2", "bof_weighted", "doc_sif", "pair_cosine", "sentence_triples", "sentence_stats", "sentence_ids_truncated", "centroid_predict", "mask_urls", "stratified_folds", "vocabulary_matrix", "mean_cosine", "context_vectors", "normalized_sentences", "padded_batches", "shard_numbers", "head_tail_split", "retrieval_accuracy", "accuracy_and_f1", "length_quality_correlation"]
FILES = ["read_labelled", "read_labelled_titles", "read_file_per_class", "read_pairs", "read_corpus", "read_vocabulary", "read_word_vectors", "vectors_to_parquet", "cooc_parquet", "cooc_records", "sentence_shards", "sentence_dump", "read_sentences"]
FITTED = ["least_squares_map", "least_squares_map_shifted", "orthogonal_map", "vocabulary_expansion", "ridge_fit", "glove_loss", "bong_all", "vocabulary_vectors", "seeded_split", "first_sentences", "fold_training_rows", "finite_and_rounded", "byte_input", "ascii_folded"]


@pytest.mark.parametrize("name", FAST + FILES + FITTED)
def test_query_against_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got = rq.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = con.execute(rq.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([row[names.index(c)] for c in cols]) for row in cur.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == want


def test_command_line(spark, tmp_path):
    from lexigrid import __main__ as cli

    write(tmp_path / "corpus.txt", "a b a c\nb a\n\nc c d\n" * 5)
    at = lambda n: str(tmp_path / n)
    args = cli.parser().parse_args(["thru-glove", at("vocab"), "-i", at("corpus.txt"), "-c", at("cooc.parquet"), "-o", at("vectors.parquet"), "-d", "3", "-n", "2", "-m", "5"])
    assert cli.steps("thru-cooc") == ["vocab", "cooc"] and cli.steps("sn") == ["sn"]
    cli.run(spark, args)
    assert [r["value"] for r in spark.read.text(at("vocab")).collect()] == ["a 15", "c 15", "b 10", "d 5"]
    assert spark.read.parquet(at("cooc.parquet")).where("i > j").isEmpty()
    got = {r["word"]: r["vec"] for r in spark.read.parquet(at("vectors.parquet")).collect()}
    assert set(got) == set("abcd") and all(len(v) == 3 for v in got.values())


def test_odd_texts_come_back_whole_from_delimited_files(spark, tmp_path):
    from lexigrid.plans import file_queries

    texts = ["", " ", "  a", "a  ", "\x00a", "a\x1f", "a\x00\"b", '"', '""', "a\\", 'a, "b" ,c', "#a", "x" * 200_000, None]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, label in ((file_queries.read_labelled, "en"), (file_queries.read_labelled_titles, "en:s")):
        got = {(r["label"], r["text"]): r["n"] for r in query(spark, str(tmp_path)).collect()}
        assert got == {(label, t or ""): 1 + (not t) for t in texts}


def test_lines_are_numbered_over_a_folder_of_files(spark, tmp_path):
    from lexigrid.plans.file_queries import _ordered_file

    rows = spark.range(0, 5000, 1, 7).select(F.col("id"), F.repeat(F.lit("y"), (F.col("id") * 7 % 50).cast("int")).alias("pad"))
    path = _ordered_file(rows.orderBy(F.rand(1)), F.concat_ws(" ", "id", "pad"), "id", str(tmp_path / "lines"))
    assert len([p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-")]) > 1
    found = readers.numbered_lines(spark, path)
    assert found.count() == 5000 and found.where(F.split("value", " ")[0].cast("long") != F.col("line_no")).isEmpty()
