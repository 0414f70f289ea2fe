"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time


def rare(spark, corpus) -> str:
    """A word of the corpus that one document holds (the first such word by hash, of 8 letters or more)."""
    from pyspark.sql import functions as F

    words = corpus.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[a-z]{8,}"), F.lit(0)))).alias("w"))
    return words.groupBy("w").count().filter("count = 1").orderBy(F.xxhash64("w"), "w").first()["w"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    from gramforge.operators.index import TrigramIndex
    from gramforge.operators.scan import Pattern
    from gramforge.operators.search import Search
    from gramforge.plans import catalogue

    folder = tempfile.mkdtemp(prefix="gramforge-bench-")
    # the table is one row group, which one task would read; stored by id in row groups of some MB, as large tables are
    catalogue.corpus(spark, sf).repartitionByRange(2 * int(cpus), "file_id").sortWithinPartitions("file_id").write.option("parquet.page.row.count.limit", 200).parquet(f"{folder}/corpus")
    corpus = spark.read.parquet(f"{folder}/corpus")
    times: dict[str, float] = {}

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name: str, action, rounds: int = 3) -> None:
        action()  # compiled code and caches of the operating system
        took = []
        for _ in range(rounds):
            start = time.perf_counter()
            action()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 4)

    index: dict[str, TrigramIndex] = {}
    for mode in ("compat", "lossless"):
        timed(f"build_{mode}", lambda m=mode: index.update({m: TrigramIndex.build(corpus, f"{folder}/{m}", m)}), rounds=1)
    patterns = {"the": Pattern("the"), "of_the": Pattern("of the"), "license_ci": Pattern("License", ignore_case=True), "rare": Pattern(rare(spark, corpus)), "missing": Pattern("zzzqqq")}
    for name, p in patterns.items():
        for way in ("scan", "compat", "lossless"):
            timed(f"{way}_{name}", lambda p=p, w=way: run(Search(corpus, index.get(w), p).files_only().to_df()))
    timed("scan_regex", lambda: run(Search(corpus, None, Pattern(r"th.{1,4}on\w*\.$", regex=True)).files_only().to_df()))
    timed("scan_lines", lambda: run(Search(corpus, None, Pattern("of the")).to_df()))
    timed("topk_density", lambda: run(Search(corpus, None, Pattern("the")).without_index().files_only().limit(10).to_df()))
    size = sum(os.path.getsize(os.path.join(d, f)) for m in index for d, _, fs in os.walk(f"{folder}/{m}") for f in fs if "/postings" in d)
    print(json.dumps({"metric": "search_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "postings_mb": round(size / 1e6, 2)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
