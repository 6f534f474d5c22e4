"""Command line: build a corpus, query it, serve it, look at it or delete it.

    python -m wordloom build FOLDER --texts input.txt --catalog catalog.json [--fields fields.json]
    python -m wordloom add_metadata FOLDER FILE [--key FIELD]
    python -m wordloom query FOLDER '{"database": ..., ...}'
    python -m wordloom schema|serve|pristine FOLDER
"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from wordloom.api import Engine, serve
from wordloom.plans.corpus import Corpus
from wordloom.plans.fields import infer_frame, parse_descriptions
from wordloom.sources import readers


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wordloom")
    parser.add_argument("command", choices=("build", "add_metadata", "query", "schema", "serve", "pristine"))
    parser.add_argument("folder")
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--texts")
    parser.add_argument("--catalog")
    parser.add_argument("--fields")
    parser.add_argument("--key")
    parser.add_argument("--port", type=int, default=10012)
    args = parser.parse_args(argv)
    name = Path(args.folder).name
    if args.command == "pristine":
        if not (Path(args.folder) / "fields").exists():
            print(f"{args.folder} holds no corpus", file=sys.stderr)
            return 1
        shutil.rmtree(args.folder)
        return 0
    spark = SparkSession.builder.appName("wordloom").getOrCreate()
    if args.command == "build":
        catalog = readers.catalog(spark, args.catalog).dropDuplicates(["filename"])
        fields = parse_descriptions(Path(args.fields).read_text()) if args.fields else infer_frame(catalog)
        Corpus.from_documents(name, readers.texts(spark, args.texts).join(catalog, "filename"), fields).build(args.folder)
        return 0
    corpus = Corpus.open(spark, args.folder)
    if args.command == "add_metadata":
        df, key = readers.metadata(spark, args.argument)
        more = corpus.add_metadata(df, args.key or ("bookid" if key == "filename" else key))
        more.save_tables(args.folder, [t for t, df in more.tables.items() if corpus.tables.get(t) is not df])
        return 0
    engine = Engine(corpus)
    if args.command == "serve":
        serve(engine, port=args.port).serve_forever()
    out = engine.query({"database": corpus.name, "method": "schema"} if args.command == "schema" else args.argument)
    if isinstance(out, bytes):
        sys.stdout.buffer.write(out)
    else:
        print(out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
