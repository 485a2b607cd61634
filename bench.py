"""Headline timings: prints one JSON line. Reads $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kireme import queries as Q
    from kireme.operators import relational as R
    from kireme.plans.segmenter import Segmenter, space_model

    runs = {n: Q.QUERIES[n] for n in ("segments", "linear_arrow", "char_ngrams", "dict_extract", "dict_lir_features", "eval_micro_prf", "gold_boundaries", "window_slots", "int16_score", "partial_parse")}
    try:
        import corpus_pipeline
        from kireme.llm import queries as L

        runs |= L.QUERIES | {"pipeline": corpus_pipeline.run}
    except ImportError:
        pass
    done = {}
    for name, query in runs.items():
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        start = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        done[name] = round(time.time() - start, 3)
    lines = R.lines(spark.read.parquet(f"{sf}/documents.parquet")).repartition(int(cpus) * 4).cache()
    chars = lines.agg(F.sum(F.char_length("text"))).first()[0]
    best = {}
    for label, s in (("network", Segmenter(spark, space_model(), "int32")), ("linear", Segmenter(spark, Q.small_linear_model()))):
        times = []
        for _ in range(3):
            start = time.time()
            lines.select(s.segment(F.col("text"))).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        best[label] = round(chars / min(times))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(done.values()), 3), "unit": "sec", "queries": done, "sf": sf, "chars_per_second": best, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
