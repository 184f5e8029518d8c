"""The pipeline against a plain one built of brute-force stages, and the guard for its absence."""

import numpy as np
from test_operators import S, plain_lines, prose
import random

import corpus_pipeline
from lodegraph.llm import quality, simhash, subword


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    good = [prose(rng, rng.randint(20, 150)) for _ in range(60)]
    items = [prose(rng, 30) for _ in range(5)]
    texts = good + [good[0], good[1] + " extra"] + [good[2] + "\n" + items[0]] + [" ".join(w + "$$$" for w in g.split()) for g in good[:20]] + [None, ""]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], S).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(83)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}

    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    score = quality.predict(model, np.array([quality.features(t) for t in texts]))
    left = {i: t for i, t in enumerate(texts) if score[i] >= quality.THRESHOLD}
    left = dict(zip(left, plain_lines(list(left.values()))))
    ids = list(left)
    f = simhash.fingerprints([left[i] for i in ids]).view(np.uint64)
    label = list(range(len(ids)))
    near = [[j for j in range(len(ids)) if int(np.bitwise_count(f[i] ^ f[j]).sum()) <= simhash.RADIUS] for i in range(len(ids))]
    for _ in ids:
        label = [min(label[j] for j in n) for n in near]
    left = {i: left[i] for k, i in enumerate(ids) if label[k] == k}
    squash = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    left = {i: t for i, t in left.items() if not any(squash(x) in squash(t) for x in items)}
    lib = subword.codec().model
    assert {i: (r.n_pieces, r.ids_sha256) for i, r in got.items()} == {i: (len(e), subword.ids_digest(e)) for i, t in left.items() for e in [lib.encode(t)]}


def test_stages_keep_the_columns(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], S).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    empty = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_with_null_ids_repeats_and_other_columns(spark, tmp_path):
    rng = random.Random(22)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    texts = [*base, base[0], base[0], None, "", None, "w" * 30_000, " ".join(base)]
    ids = [*range(24), None, 0, None, None, 30, 30, 31, 32]
    path = str(tmp_path)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], S)
    from pyspark.sql import functions as F

    df = df.withColumns({c: F.lit(3) for c in ("th", "th_", "id_", "hits_", "score", "__th", "__id", "__hits", "n", "w")})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(30, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, base[3]), (None, base[4])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    at = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, path)
        assert out.columns == df.columns, name
        out.write.parquet(f"{path}/{k}")
        at = spark.read.parquet(f"{path}/{k}")
    left = {(r.doc_id, r.text) for r in at.collect()}
    assert not any(t and (base[3] in t or base[4] in t) for _, t in left) and len(left) > 15
    assert len({t for _, t in left}) == len(left)
    assert corpus_pipeline.STAGES[-1][1](spark, at, path).count() == at.count()
