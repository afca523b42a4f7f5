import random

import corpus_pipeline
from groundline.llm import common, simhash

TOX, LEAK = "you idiot moron scum ", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
TOXIC = range(30, 36)


def test_pipeline(spark, tmp_path):
    base = {k: " ".join(f"w{k}x{j % 37}" for j in range(80)) for k in range(12)}
    rows = [(k, base[k], "en", "s", 1) for k in range(10)] + [(20, base[3], "en", "s", 1), *((k, TOX + base[10] + f" z{k}", "en", "s", 1) for k in TOXIC), (22, base[11] + " " + LEAK, "en", "t", 1), (23, None, None, None, None), (None, "lone text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*((k, 1, 1) for k in TOXIC), *((k, 1, 0) for k in range(10))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = [r.doc_id for r in docs.collect()]
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(seen["toxicity"], key=str) == sorted((r[0] for r in rows if r[0] not in TOXIC), key=str)
    assert 20 not in seen["near_dedup"] and {3, 22, 23, None} <= {*seen["near_dedup"]}
    assert 22 not in seen["decontamination"] and {23, None} <= {*seen["decontamination"]}
    assert sorted(seen["mixing"], key=str) == sorted(seen["token_output"], key=str) and 23 in seen["mixing"]


def test_near_copies_are_checked_by_their_shingles(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((100 * k, " ".join(base)))
        for j, changes in enumerate((2, 5, 8, 10, 12, 14)):
            some = list(base)
            for at in rng.sample(range(300), changes):
                some[at] = f"n{rng.randrange(10**9)}"
            rows.append((100 * k + j + 1, " ".join(some)))
    rows += [(5000, rows[0][1]), (5001, None), (5002, ""), (None, rows[0][1]), (None, "a lone text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", common.F.lit(0)).withColumn("root", common.F.lit(0))
    sets = {i: {*simhash._shingle_hashes(t or "", 5).tolist()} for i, t in rows if i is not None}
    like = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    gone = {*sets} - {*kept}
    assert gone and all(any(like(a, b) for b in sets if b != a and b // 100 == a // 100 or b < 5) for a in gone)
    assert {5000, 5002} <= gone and None in kept and len(kept) == len({*kept})  # the copy without id goes too


def test_near_copies_with_repeated_and_null_ids(spark):
    long, more, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "lmo")
    rows = [(1, long), (2, long), (2, more), (5, more), (None, long), (None, more), (None, other), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("copies", common.F.lit(1)).withColumn("h", common.F.lit("x"))
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, long), (2, more), (None, other), (7, None)], key=str)


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    names = ["score", "__text", "copies", "mixed_id", "__copy", "leak_id", "h", "copy", "size", "k", "begin", "kept_id", "Text_"]
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "en", "s", 1) for k in range(6)] + [(None, None, None, None, None), (3, "other text of three", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, name in enumerate(names):
        docs = docs.withColumn(name, common.F.lit(n + 0.5))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            got = out.collect()
            if df is not docs:
                assert not got
            if name != "token_output":
                assert out.columns == docs.columns
                assert all(r[n] == k + 0.5 for r in got for k, n in enumerate(names))
            elif df is docs:
                assert len(got) == len(rows)
    left = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert left == {0, 1, 2, 3, 4, None}
