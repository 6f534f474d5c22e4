"""Times the headline queries: $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].  Prints one line of JSON.

A corpus is built once, as a user would (build_corpus), and the JSON queries are asked of it, each result collected; the best of
RUNS is given, after one unmeasured query.  Operators of wordloom.llm and the pipeline are timed once, with their results written nowhere.
"""

from __future__ import annotations

import importlib.util
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from wordloom.api import Engine  # noqa: E402
from wordloom.plans.corpus import Corpus  # noqa: E402
from wordloom.queries import CATALOG, QUERIES  # noqa: E402

RUNS = 3
ASKED = {
    "words_per_million": {"search_limits": {"word": ["the"]}, "groups": ["lang"], "counttype": "WordsPerMillion"},
    "multiword_or": {"search_limits": {"word": ["of", "on"]}, "groups": ["lang"], "counttype": ["WordCount", "TextCount"]},
    "bigram_phrase": {"search_limits": {"word": ["of the"]}, "groups": ["source"], "counttype": ["WordCount", "TextCount"]},
    "metadata_only": {"groups": ["lang", "source"], "counttype": ["WordCount", "TextCount"]},
    "star_limit": {"search_limits": {"word": ["of"], "*source": "src1"}, "groups": ["lang"], "counttype": "WordsPerMillion"},
    "pmi_words": {"search_limits": {"word": ["the", "la"]}, "groups": ["lang", "source"], "counttype": "PMI_words"},
    "dunning_by_word": {"search_limits": {"lang": "en", "source": "src1"}, "compare_limits": {"lang": "en", "source": "src2"}, "groups": ["unigram"], "counttype": "Dunning"},
    "bibliography": {"method": "search", "search_limits": {"word": ["the"], "lang": "en"}},
}
FROM_TEXTS = ("flagship", "tokens_unigram_counts", "group_by_unigram", "vocabulary_topn", "anchored_snowflake", "pretokenized_counts")


def timed(f) -> float:
    start = time.time()
    f()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="wordloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{work}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    try:
        QUERIES["flagship"](spark, sf).collect()
        for name in FROM_TEXTS:
            seconds[f"text_{name}"] = min(timed(lambda n=name: noop(QUERIES[n](spark, sf))) for _ in range(RUNS))
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        seconds["build_corpus"] = timed(lambda: Corpus.from_documents("library", docs, CATALOG, key="doc_id").build(f"{work}/corpus"))
        engine = Engine(Corpus.open(spark, f"{work}/corpus").cache())
        for name, query in ASKED.items():
            q = {"database": "library", "groups": [], "counttype": "WordCount"} | query
            seconds[name] = min(timed(lambda q=q: engine.frame(q).collect()) for _ in range(RUNS))
        if importlib.util.find_spec("wordloom.llm") is not None:
            from wordloom.llm.queries import QUERIES as OPERATORS

            for name, query in OPERATORS.items():
                seconds[name] = timed(lambda f=query: noop(f(spark, sf)))
            if importlib.util.find_spec("corpus_pipeline") is not None:
                import corpus_pipeline

                seconds["pipeline"] = timed(lambda: noop(corpus_pipeline.run(spark, sf)))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
