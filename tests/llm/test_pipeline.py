from __future__ import annotations

import __spark_entry__
import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from wordloom.llm import mixing, packing, passages, quality_rules, simhash
from wordloom.llm.text import WORD, fold

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, t string, keep int"


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_step_by_step(spark, sf, tmp_path):
    """Each stage against a plain computation over what its predecessor kept, and run() against all of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs.collect())
    start = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = quality_rules.fit(spark.read.parquet(f"{sf}/documents.parquet"), marks)
    import pyarrow as pa

    p = model.chance(pa.array([r.text for r in start]))
    assert {r.doc_id for r in outs[0]} == {r.doc_id for r, x in zip(start, p, strict=True) if x >= quality_rules.KEEP}
    from test_simhash import brute

    texts, pairs = brute([(r.doc_id, r.text) for r in outs[0]])
    group = {t: i for i, t in enumerate(texts)}
    for i, j in pairs:
        a, b = group[texts[i]], group[texts[j]]
        group = {t: (a if g == b else g) for t, g in group.items()}
    least = {}
    for r in outs[0]:
        least.setdefault(group[r.text], []).append(r.doc_id)
    assert {r.doc_id for r in outs[1]} == {min(g) for g in least.values()}
    seen = set()
    want = {}
    for r in sorted(outs[1]):
        words = [fold(x) for x in WORD.findall(r.text)]
        flags = [False] * len(words)
        for i in range(len(words) - passages.LENGTH + 1):
            key = tuple(words[i : i + passages.LENGTH])
            if key in seen:
                flags[i : i + passages.LENGTH] = [True] * passages.LENGTH
            seen.add(key)
        left = [w for w, f in zip(words, flags, strict=True) if not f]
        if left or not words:
            want[r.doc_id] = left
    assert {r.doc_id: [fold(x) for x in WORD.findall(r.text)] for r in outs[2]} == want
    by_id = {r.doc_id: r for r in outs[2]}
    counts = {}
    for r in outs[2]:
        counts[r.source] = counts.get(r.source, 0) + 1
    quota = mixing.block_quotas(counts, mixing.target_weights(counts), mixing.BLOCK_ROWS)
    assert all(by_id[r.doc_id] == r for r in outs[3]) and len({r.doc_id for r in outs[3]}) == len(outs[3])
    for s, n in counts.items():
        got = sum(r.source == s for r in outs[3])
        assert got == n if quota[s] * mixing.BLOCK_ROWS >= n else quota[s] * mixing.BLOCK_ROWS - mixing.BLOCK_ROWS < got <= quota[s] * mixing.BLOCK_ROWS
    pieces = {}
    for b in outs[4]:
        assert b.used == sum(x.n_tokens for x in b["items"]) <= packing.CAPACITY
        for x in b["items"]:
            pieces.setdefault(x.doc_id, []).append((x.piece, x.text))
    assert {d: "".join(t for _, t in sorted(x)) for d, x in pieces.items()} == {r.doc_id: r.text for r in outs[3] if r.text.split()}
    whole = corpus_pipeline.run(spark, sf).select(F.explode("items").alias("x")).select("x.*").collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(x) for b in outs[4] for x in b["items"])


@pytest.mark.parametrize("rows", [[], [(1, "one two", "en", "s", 7, "mine", "t", 1), (1, "one two", "en", "s", 7, "mine", "t", 1), (None, None, None, None, None, None, None, None), (2, "", "en", "", 0, "mine", None, 0), (3, "word " * 100_000, None, None, None, "mine", "x", 2)]])
def test_awkward_documents(spark, tmp_path, rows):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            assert all(r.shard in ("mine", None) for r in out.collect())
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert sorted({x for b in docs.collect() for x in b.doc_ids}) == ([1, 3] if rows else [])
    assert simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).count() == max(0, len(rows) - 1)


def test_mix_stage_writes_shards_in_order(spark, tmp_path):
    """With a hot source: each part of the stage's Parquet is a run of one shard by position, not of one source."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "hot" if i % 4 else f"s{i % 3}", 6, "mine", "t", 1) for i in range(4000)], DOCS)
    place = {r.doc_id: (r.s, r.p) for r in mixing.mix(docs, names=("s", "p")).collect()}
    corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "out"))
    seen = []
    for path in sorted((tmp_path / "out").glob("*.parquet")):
        rows = pq.read_table(path).to_pylist()
        at = [place[r["doc_id"]] for r in rows]
        assert at == sorted(at) and len({s for s, _ in at}) <= 1
        assert len(rows) < 50 or len({r["source"] for r in rows[: len(rows) // 2]}) > 1
        seen += at
    assert sorted(seen) == sorted(place.values()) and len({s for s, _ in seen}) == mixing.SHARDS


def test_runs_of_a_large_shard_follow_its_positions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 100)
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a" if i % 4 else "b", 6, "mine", "t", 1) for i in range(3000)], DOCS)
    out = mixing.mix(docs, shards=3, names=("s", "p"), in_order=True).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, r.s, r.p) for r in out) == sorted((r.doc_id, r.s, r.p) for r in mixing.mix(docs, shards=3, names=("s", "p")).collect())
    assert [(r.s, r.p) for r in sorted(out, key=lambda r: r.part)] == sorted((r.s, r.p) for r in out)
    assert len({r.part for r in out}) > 3
