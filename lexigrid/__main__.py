"""python -m lexigrid MODE: vocabularies, co-occurrence counts and word vectors from a corpus file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexigrid.operators import cooc, counts, training
from lexigrid.operators.runtime import settle
from lexigrid.sources import readers, sinks

MODES = ("vocab", "cooc", "glove", "sn", "thru-cooc", "thru-glove", "thru-sn")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m lexigrid", description=__doc__)
    out.add_argument("mode", choices=MODES, help="one step, or all steps up to one (thru-)")
    out.add_argument("vocab", help="vocabulary text folder: `word count` a line, most frequent first")
    out.add_argument("-i", "--input", help="corpus text, one document a line")
    out.add_argument("-c", "--cooc", help="co-occurrence Parquet folder")
    out.add_argument("-o", "--output", help="word vectors, Parquet folder of id, word, vec")
    out.add_argument("-m", "--min_count", type=int, default=1, help="least count of a word")
    out.add_argument("-w", "--window_size", type=int, default=10, help="furthest places apart")
    out.add_argument("-u", "--unweighted", action="store_true", help="count pairs whatever their distance")
    out.add_argument("-d", "--dimension", type=int, default=300, help="of the vectors")
    out.add_argument("-x", "--xmax", type=float, default=100.0, help="count from which an entry has full weight")
    out.add_argument("-a", "--alpha", type=float, default=0.75, help="exponent of the weight")
    out.add_argument("-s", "--sgd", action="store_true", help="plain gradient steps in place of AdaGrad")
    out.add_argument("-n", "--niter", type=int, default=25, help="epochs")
    out.add_argument("-e", "--eta", type=float, default=0.05, help="step size")
    out.add_argument("-v", "--verbose", action="store_true", help="print the loss of each epoch")
    return out


def steps(mode: str) -> list[str]:
    """The steps of a mode, in order."""
    if not mode.startswith("thru-"):
        return [mode]
    last = mode.removeprefix("thru-")
    return ["vocab", "cooc"] + ([last] if last != "cooc" else [])


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Do the steps of args.mode; each reads what the one before it wrote."""
    for step in steps(args.mode):
        if step == "vocab":
            sinks.vocabulary_text(counts.corpus_vocabulary(readers.corpus(spark, args.input), min_count=args.min_count), args.vocab)
            continue
        vocabulary = settle(readers.vocabulary_file(spark, args.vocab))
        if step == "cooc":
            sinks.cooccurrence_parquet(cooc.cooccurrence(readers.corpus(spark, args.input), vocabulary, args.window_size, args.unweighted), args.cooc)
            continue
        trainer = training.WordVectorTrainer(args.dimension, step, "sgd" if args.sgd else "adagrad", args.niter, args.eta, args.alpha, args.xmax)
        vectors = trainer.fit(spark.read.parquet(args.cooc), vocabulary.count())
        sinks.vectors_parquet(vectors.join(vocabulary, "id").select("id", "word", "vec"), args.output)
        if args.verbose:
            print("\n".join(f"epoch {k}: loss {x:.6f}" for k, x in enumerate(trainer.losses, 1)))


if __name__ == "__main__":
    run(SparkSession.builder.appName("lexigrid").getOrCreate(), parser().parse_args())
