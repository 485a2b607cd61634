"""Commands: ``spark-submit -m``-style entry for predict, train, evaluate and extract-dict.

    python -m kireme.cli predict --model M --input DIR --output DIR
    python -m kireme.cli train --backend mlp|ed --full F... --partial P... --dict D... --out M
    python -m kireme.cli evaluate --gold G --predicted P
    python -m kireme.cli extract-dict --input C --output DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kireme.errors import SegmentationError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kireme", description="word segmentation on Spark")
    p.add_argument("--version", action="version", version="kireme 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("predict", help="segment lines of text")
    a.add_argument("--model", required=True)
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--partitions", type=int)
    a = sub.add_parser("train", help="train a model on annotated corpora")
    a.add_argument("--backend", choices=("mlp", "ed"), default="mlp")
    a.add_argument("--full", nargs="*", default=[])
    a.add_argument("--partial", nargs="*", default=[])
    a.add_argument("--dict", nargs="*", default=[])
    a.add_argument("--dev")
    a.add_argument("--out", required=True)
    for name, kind, default in (("window", int, 5), ("dim", int, 64), ("hidden", int, 256), ("min-count", int, 2), ("epochs", int, 100), ("batch", int, 256), ("patience", int, 15), ("seed", int, 42), ("lr", float, 1e-3), ("decay", float, 0.0), ("feedback-decay", float, 0.01)):
        a.add_argument(f"--{name}", type=kind, default=default)
    a.add_argument("--optimizer", choices=("adam", "sgd"), default="adam")
    a.add_argument("--embedding-update", choices=("hybrid", "pure"), default="hybrid")
    a.add_argument("--learn-feedback", action="store_true")
    a = sub.add_parser("evaluate", help="boundary precision, recall and F1 of two files of words")
    a.add_argument("--gold", required=True)
    a.add_argument("--predicted", required=True)
    a = sub.add_parser("extract-dict", help="frequent words of an annotated corpus")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--min-count", type=int, default=2)
    a.add_argument("--min-length", type=int, default=1)
    return p


def predict(spark: SparkSession, o: argparse.Namespace) -> None:
    """Lines keep their order: numbers come with the read, and the sink sorts by them."""
    from kireme.plans.segmenter import Segmenter
    from kireme.sources.corpus import read_numbered_lines

    lines = read_numbered_lines(spark, o.input)
    if o.partitions:
        lines = lines.repartition(o.partitions)
    made = Segmenter.load(spark, o.model).format_lines(lines)
    line = F.when(F.col("line").isNull(), F.raise_error(F.concat(F.lit("invalid UTF-8 in line "), F.col("line_no").cast("string")))).otherwise(F.col("line"))
    made.select("path", "line_no", line.alias("line")).sort("path", "line_no").select("line").write.text(o.output)


def train(spark: SparkSession, o: argparse.Namespace) -> None:
    from kireme.plans import training as T
    from kireme.plans.network import Config, Diffusion
    from kireme.sources.corpus import read_annotated, read_dictionary, union_corpora
    from kireme.sources.models import serialize_neural

    if not o.full and not o.partial:
        raise SystemExit("train needs a corpus")
    if not (1 <= o.window <= 255 and 1 <= o.dim <= 256 and o.hidden >= 1 and len(o.dict) <= 255):
        raise SystemExit("a dimension is out of range")
    corpus = union_corpora([read_annotated(spark, p) for p in o.full], [read_annotated(spark, p, "partial") for p in o.partial]).cache()
    dicts = [T.word_lists(read_dictionary(spark, p)) for p in o.dict]
    vocab = T.build_vocabulary(corpus, o.min_count)
    examples = T.build_examples(corpus, vocab, dicts, o.window).cache()
    for r in T.example_statistics(examples).collect():
        print(f"{r['status']}: {r['n']}", file=sys.stderr)
    dev = T.build_examples(read_annotated(spark, o.dev), vocab, dicts, o.window).cache() if o.dev else None
    config = Config(o.window, o.dim, o.hidden, len(vocab) + 2, len(dicts))
    diffusion = Diffusion(o.embedding_update, learn=o.learn_feedback, decay=o.feedback_decay) if o.backend == "ed" else None
    options = T.Options(o.epochs, 1, o.batch, o.patience, o.seed, o.optimizer, o.lr, o.decay, diffusion)
    found = T.train(examples, dev, config, options, report=lambda s: print(s, file=sys.stderr))
    model = T.export(dev if dev is not None else examples, found.params, config, vocab, dicts, o.backend)
    gaps = T.sign_flips(corpus, model).first()
    print(f"flips: {gaps['flips']} of {gaps['gaps']}; best dev F1: {found.metrics['f1'] if found.metrics else 'none'}", file=sys.stderr)
    with open(o.out, "wb") as f:
        f.write(serialize_neural(model))


def evaluate(spark: SparkSession, o: argparse.Namespace) -> None:
    from kireme.operators.relational import boundary_metrics
    from kireme.sources.corpus import read_numbered_lines

    read = lambda p: read_numbered_lines(spark, p).select("line_no", F.col("text").alias("line"))
    print(boundary_metrics(read(o.gold), read(o.predicted)).first().asDict())


def extract(spark: SparkSession, o: argparse.Namespace) -> None:
    from kireme.functions.text import escape_word, unescape_words
    from kireme.operators.relational import extract_dictionary
    from kireme.sources.corpus import read_lines

    words = read_lines(spark, o.input).select(F.explode(unescape_words(F.col("text"), keep_empty=False)).alias("word"))
    extract_dictionary(words, o.min_count, o.min_length).sort("word").select(escape_word(F.col("word")).alias("word")).write.text(o.output)


def main(args: list[str] | None = None) -> int:
    """0 if all went well, 1 if the data or the model is at fault, 2 for wrong options."""
    o = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        {"predict": predict, "train": train, "evaluate": evaluate, "extract-dict": extract}[o.command](spark, o)
    except SegmentationError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
