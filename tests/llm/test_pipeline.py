import corpus_pipeline
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from test_line_spread import brute as spread_brute
from test_near_copies import shingles
from test_packing import check

from tallyward.llm import pii_spans, quality


def brute_near(docs):
    sets = [(d[0], shingles(d[1], 5)) for d in docs]
    group = {doc: doc for doc, _ in sets}
    changed = True
    while changed:
        changed = False
        for n, (a, x) in enumerate(sets):
            for b, y in sets[:n]:
                if x and y and group[a] != group[b] and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return [d for d in docs if group[d[0]] == d[0]]


def test_run_against_brute_force(spark, frame, rng, tmp_path):
    docs, labels = [], []
    boiler = prose(rng, 9)
    for n in range(240):
        words = [f"k{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 150]))]
        if n % 6 == 0:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words)
        if n % 3 == 1:
            text += "\n" + boiler
        if n % 10 == 3:
            text += f"\nwrite to someone{n}@example.org or call +1 (226) 555-19{n % 90 + 10}"
        docs.append(document(n, text, f"s{n % 12}"))
        labels.append((n, int(n % 6 != 0), 0))
    for n in range(240, 280):  # copies, some with a changed word
        base = docs[n - 240 + 1][1].split(" ")
        if n % 2:
            base[len(base) // 2] = "changed"
        docs.append(document(n, " ".join(base), f"s{n % 12}"))
    frame(docs, 4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(source, quality.training_labels(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    score = {r["doc_id"]: r["score"] for r in rows(quality.score(source, model))}
    kept = [d for d in docs if score[d[0]] >= 0.5]
    assert {d[0] for d in kept} == {d[0] for d in docs if d[0] % 6 != 0 and d[0] < 240} | {d[0] for d in docs if d[0] >= 240 and (d[0] - 239) % 6 != 0}
    clean = {doc: text for doc, text, _ in spread_brute(kept, 8)}
    kept = brute_near([document(d[0], clean[d[0]], d[3]) for d in kept])
    spans = pii_spans.fit(spark.createDataFrame(kept, source.schema))
    want = [(d[0], pii_spans.masked_text(d[1], pii_spans.all_spans(spans, d[1]))) for d in kept]
    check(want, rows(corpus_pipeline.run(spark, str(tmp_path))), 1024)
    assert any("[EMAIL] or call [PHONE]" in text for _, text in want) and len(want) < 240


def test_odd_rows(spark, frame, odd_rows, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for source in (frame(odd_rows), frame([])):
        docs = source.withColumn("spans", F.lit(1)).withColumn("id", F.lit("x")).withColumn("row", F.lit(2.0))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).count() >= docs.count()


def test_contract(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "personal_data", "best_fit_packing"]


def through(spark, docs, tmp_path, stages=corpus_pipeline.STAGES[:-1]):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    for _, stage in stages:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    return docs


def test_extra_columns_keep_their_values(spark, frame, rng, tmp_path):
    """Names that the operators use themselves, and names with dots and backticks."""
    from pyspark.sql import functions as F

    docs = frame([document(n, f"{prose(rng, 30)}\nshared line", f"s{n}") for n in range(12)])
    names = ["n_lines", "n_removed", "a.b", "x`y", "row", "removed", "again", "kept", "spans", "c0", "h1"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    got = [r.asDict() for r in through(spark, docs, tmp_path).collect()]
    assert len(got) == 12
    for r in got:
        assert all(r[name] == f"{name} {r['doc_id']}" for name in names)
        assert r["n_chars"] == len(r["text"])
    assert sum("shared line" in r["text"] for r in got) == 1


def test_repeated_rows_and_null_lengths(spark, frame, rng, tmp_path):
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = [document(1, a), document(2, b), document(3, c), document(3, c), document(4, None), document(4, None), document(5, ""),
            document(None, b + " x"), document(6, c), document(7, "only"), document(7, "other")]
    docs = [(*d[:4], 99 if d[1] is None else d[4]) for d in docs]
    got = through(spark, frame(docs), tmp_path, corpus_pipeline.STAGES[1:-1])
    found = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in rows(got)), key=str)
    assert found == sorted([(1, a, len(a)), (2, b, len(b)), (3, c, len(c)), (4, None, 99), (5, "", 0), (None, b + " x", len(b) + 2),
                            (7, "only", 4), (7, "other", 5)], key=str)


def test_hostile_texts_end(spark, frame, tmp_path):
    """Long runs of a few characters pass every stage in bounded time."""
    import time

    docs = [document(n, run * (30_000 // len(run))) for n, run in enumerate(["0", "0.", "9", "<a'", "a@", '"', "+1 ", "\n", " ", "a "])]
    docs.append(document(99, "1." + "0" * 5000 + ".0.1"))
    start = time.perf_counter()
    assert through(spark, frame(docs, 8), tmp_path).count() >= len(docs) - 4
    assert time.perf_counter() - start < 240
