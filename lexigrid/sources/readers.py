"""Readers of labelled documents, pairs, corpora, word vectors, vocabularies and co-occurrence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions import text as tx


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, gapless), value of a text file, or of a folder of files by name, in their order.

    Files are read in blocks whose rows come in order, so each row's own number in
    its block plus the rows of the blocks before it is its line.
    """
    from lexigrid.operators.runtime import settle

    lines = settle(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")))
    blocks = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()  # a row a block
    base, total = [], 0
    for r in sorted(blocks, key=lambda r: (r["_file"], r["_start"])):
        base.append((r["_file"], r["_start"], total - r["first"]))
        total += r["n"]
    known = F.broadcast(spark.createDataFrame(base, "_file string, _start long, _base long"))
    return lines.join(known, ["_file", "_start"]).select((F.col("_at") + F.col("_base")).alias("line_no"), "value")


def labelled(spark: SparkSession, path: str, delimiter: str = "\t", split_label: bool = False, columns: tuple[str, ...] = ("label", "text")) -> DataFrame:
    """label, text of a delimited file, a record a line; split_label keeps what is before the first colon.

    Fields may be quoted, with quotes inside doubled. Every other character stays as
    it is, at the ends too; missing fields are null, blank lines are left out.
    """
    places = [columns.index(c) for c in ("label", "text")]

    def parse(batches):
        import csv
        import sys

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            out: list[list] = [[], []]
            for line in batch.column(0).to_pylist():
                cells = next(csv.reader([line], delimiter=delimiter), [])
                for own, k in zip(out, places) if cells else ():
                    own.append(cells[k] if k < len(cells) else None)
            yield pa.record_batch([pa.array(x, type=pa.string()) for x in out], names=["label", "text"])

    rows = spark.read.text(path).mapInArrow(parse, "label string, text string")
    return rows.select((tx.label_prefix(F.col("label")) if split_label else F.col("label")).alias("label"), "text")


def one_file_per_class(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id, text, label: stripped lines, the file's number as label; blank lines stay as empty documents."""
    out, start = None, 0
    for label, path in enumerate(paths):
        own = numbered_lines(spark, path).select((F.col("line_no") + start).alias("doc_id"), tx.strip(F.col("value")).alias("text"), F.lit(label).alias("label"))
        start += own.count()
        out = own if out is None else out.unionByName(own)
    return out


def sst(spark: SparkSession, folder: str, partitions=("train", "test"), fine: bool = False) -> dict[str, DataFrame]:
    return {p: labelled(spark, f"{folder}/{'sst_fine' if fine else 'sst'}_{p}.csv") for p in partitions}


def imdb(spark: SparkSession, folder: str, partitions=("train", "test")) -> dict[str, DataFrame]:
    """'unsup' gives text alone."""
    unlabelled = lambda p: spark.read.text(p).select(tx.strip(F.col("value")).alias("text"))
    return {p: unlabelled(f"{folder}/imdb_unsup.txt") if p == "unsup" else labelled(spark, f"{folder}/imdb_{p}.csv") for p in partitions}


def trec(spark: SparkSession, folder: str, partitions=("train", "test"), split_label: bool = True) -> dict[str, DataFrame]:
    return {p: labelled(spark, f"{folder}/trec_{p}.csv", split_label=split_label) for p in partitions}


def dbpedia(spark: SparkSession, folder: str, partitions=("train", "test")) -> dict[str, DataFrame]:
    """Comma-delimited label, title, text; the title is left out."""
    return {p: labelled(spark, f"{folder}/dbpedia_{p}.csv", ",", columns=("label", "title", "text")) for p in partitions}


def newsgroups(table: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """text, label int from any table of posts."""
    return table.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))


def mr(spark: SparkSession, folder: str) -> DataFrame:
    return one_file_per_class(spark, f"{folder}/rt-polarity.neg", f"{folder}/rt-polarity.pos")


def cr(spark: SparkSession, folder: str) -> DataFrame:
    return one_file_per_class(spark, f"{folder}/custrev.neg", f"{folder}/custrev.pos")


def subj(spark: SparkSession, folder: str) -> DataFrame:
    return one_file_per_class(spark, f"{folder}/subj.objective", f"{folder}/subj.subjective")


def mpqa(spark: SparkSession, folder: str) -> DataFrame:
    return one_file_per_class(spark, f"{folder}/mpqa.neg", f"{folder}/mpqa.pos")


def sick(spark: SparkSession, path: str, similarity: bool = False) -> DataFrame:
    """text1, text2, label: relatedness as a double, or the entailment class."""
    names = ["pair_id", "text1", "text2", "score", "judgment"]
    rows = spark.read.schema(", ".join(f"{c} string" for c in names)).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    return rows.select("text1", "text2", (F.col("score").cast("double") if similarity else F.col("judgment")).alias("label"))


def mrpc(spark: SparkSession, path: str) -> DataFrame:
    """text1, text2, label: the last two fields and the first, below a header; quotes are text."""
    cells = F.split("value", "\t", -1)
    body = numbered_lines(spark, path).where("line_no > 0")
    return body.select(F.element_at(cells, -2).alias("text1"), F.element_at(cells, -1).alias("text2"), F.element_at(cells, 1).alias("label"))


def sts(spark: SparkSession, path: str) -> DataFrame:
    """text1, text2, label: fields 5, 6 and 4 (from 0) of tab-separated lines; quotes are text."""
    cells = F.split("value", "\t", -1)
    return spark.read.text(path).select(tx.strip(F.element_at(cells, 6)).alias("text1"), tx.strip(F.element_at(cells, 7)).alias("text2"), F.element_at(cells, 5).alias("label"))


def sst_sentences(spark: SparkSession, path: str) -> DataFrame:
    """sentence, label of a CSV file with that header."""
    return spark.read.schema("sentence string, label string").option("header", True).option("quote", '"').option("escape", '"').csv(path)


TASKS = {
    "split": {"sst": sst, "sst_fine": lambda s, f, p=("train", "test"): sst(s, f, p, fine=True), "imdb": imdb, "ng": newsgroups, "trec": trec, "dbpedia": dbpedia},
    "folds": {"mr": mr, "cr": cr, "subj": subj, "mpqa": mpqa},
    "pairs": {"sick_r": lambda s, f: sick(s, f, similarity=True), "sick_e": sick, "mrpc": mrpc, "sts": sts},
}


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: one document a line. Ids are unique, not gapless."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, first: int | None = None, dimension: int | None = None) -> DataFrame:
    """word, vec array<float> of text lines `word x x ...`, or of a Parquet folder of those columns.

    vocabulary (word) keeps only its words; first keeps the file's first lines;
    dimension keeps the first numbers of a line.
    """
    if path.rstrip("/").endswith(".parquet"):
        out = spark.read.parquet(path).select("word", "vec")
        out = out.limit(first) if first is not None else out
    else:
        lines = numbered_lines(spark, path).where(F.col("line_no") < first) if first is not None else spark.read.text(path)
        cells = F.split(F.regexp_replace("value", " +$", ""), " ")
        out = lines.select(F.element_at(cells, 1).alias("word"), F.slice(cells, F.lit(2), F.size(cells)).alias("cells"))
        if vocabulary is not None:  # before any number is parsed
            out = out.join(vocabulary.select("word"), "word", "left_semi")
        return out.select("word", F.transform(F.slice("cells", 1, dimension) if dimension else F.col("cells"), lambda x: x.cast("float")).alias("vec"))
    if vocabulary is not None:
        out = out.join(vocabulary.select("word"), "word", "left_semi")
    return out.withColumn("vec", F.slice("vec", 1, dimension)) if dimension else out


def vocabulary_file(spark: SparkSession, path: str, duplicates: str = "error") -> DataFrame:
    """word, id (the line's number). duplicates: 'error', or 'last' to keep the last line of a word."""
    lines = numbered_lines(spark, path).select(F.element_at(tx.split_words(F.col("value")), 1).alias("word"), F.col("line_no").alias("id"))
    best = lines.groupBy("word").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    if duplicates == "error" and not best.where("n > 1").isEmpty():
        raise ValueError(f"{path} has a word twice")
    return best.select("word", "id")


_RECORD = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("x", T.DoubleType())])


def binary_triples(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """i, j, x of records int32, int32, float32 (wide: float64), little-endian, a file in splits of whole records."""
    size = 16 if wide else 12
    records = spark.sparkContext.binaryRecords(path, size)

    def decode(rows):
        import numpy as np

        kind = np.dtype([("i", "<i4"), ("j", "<i4"), ("x", "<f8" if wide else "<f4")])
        held = []
        for r in rows:
            held.append(bytes(r))
            if len(held) == 50_000:
                yield from ((int(a), int(b), float(x)) for a, b, x in np.frombuffer(b"".join(held), kind))
                held = []
        yield from ((int(a), int(b), float(x)) for a, b, x in np.frombuffer(b"".join(held), kind))

    return spark.createDataFrame(records.mapPartitions(decode), _RECORD)


def blob_triples(spark: SparkSession, path: str) -> DataFrame:
    """i, j, x of a Parquet folder of blobs of 12-byte records, as sinks.cooccurrence_binary() writes them."""

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype([("i", "<i4"), ("j", "<i4"), ("x", "<f4")])
        for b in batches:
            for blob in b.column(0).to_pylist():
                got = np.frombuffer(blob, kind)
                yield pa.record_batch([pa.array(got["i"].astype(np.int32)), pa.array(got["j"].astype(np.int32)), pa.array(got["x"].astype(np.float64))], names=["i", "j", "x"])

    return spark.read.parquet(path).select("records").mapInArrow(unpack, _RECORD)


def sentence_shards(spark: SparkSession, patterns: str, shuffle_seed: int | None = None) -> DataFrame:
    """Examples of comma-separated Parquet paths, in a seeded random order if asked."""
    rows = spark.read.parquet(*[p.strip() for p in patterns.split(",") if p.strip()])
    return rows if shuffle_seed is None else rows.orderBy(F.rand(shuffle_seed))


__all__ = ["TASKS", "binary_triples", "blob_triples", "corpus", "cr", "dbpedia", "imdb", "labelled", "mpqa", "mr", "mrpc", "newsgroups", "numbered_lines", "one_file_per_class", "sentence_shards", "sick", "sst", "sst_sentences", "sts", "subj", "trec", "vocabulary_file", "word_vectors"]
