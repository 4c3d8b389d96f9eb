import corpus_pipeline
from tests.llm.helpers import documents
from tests.llm.test_toxicity import corpus


def test_stages_apply_their_operators(spark, tmp_path):
    texts, y = corpus(160)
    clean = [t for t, v in zip(texts, y, strict=True) if not v]
    texts += [clean[0], clean[0].upper(), "tail", None]
    df = documents(spark, texts, ["big" if i % 8 else "small" for i in range(len(texts))])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == df.columns
    toxic = {i for i, v in enumerate(y) if v}
    assert len(seen[0] & toxic) <= 4 and len({i for i, v in enumerate(y) if not v} - seen[0]) <= 6
    last = len(texts) - 3
    assert last in seen[1] and last - 1 not in seen[1] and y.index(0) not in seen[1]
    assert seen[2] <= seen[1] and seen[3] == seen[2] == seen[4]


def test_stages_take_rows_of_any_kind(spark, tmp_path):
    texts, y = corpus(60)
    rows = [(i, t, "en", None if i % 9 == 0 else "s", len(t), i, "mine", 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None, 1, "mine", None, None), (900, None, "en", "s", 0, 1, None, None, None), (901, "", "en", "t", 0, 1, None, None, None), (902, "long words " * 30_000, "en", "s", 1, 1, None, None, None)] + rows[:3] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, score double, _key string")
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(3, 1, None), (None, 1, 1), (4, 0, y[4])], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for at, docs in (("some", df), ("none", df.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / at / name))
            docs = spark.read.parquet(str(tmp_path / at / name))
            if name != "bpe":
                assert docs.columns == df.columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert (901 in ids and 900 not in ids) if at == "some" else not ids


def test_columns_of_any_name_are_ignored(spark):
    from tessera.llm import bpe, exact_dedup, mixing, sharding, simhash, suffix_dedup, tiff, toxicity

    texts = ["one two three four five six", None, "", "one two three four five six", "x" * 300]
    plain = documents(spark, texts, ["a", None, "b", "a", "b"])
    names = ["id", "key", "_id", "_key", "f", "x", "u", "v", "t", "n", "size", "shard", "slot", "block", "bucket", "kept", "keep_id", "score", "place", "weight", "epoch", "tokens", "ids", "group_size", "fingerprint", "root", "law", "_row", "label", "data", "n_bytes", "media_bytes"]
    wide = plain
    for n in names:
        wide = wide.withColumn(n, plain["doc_id"] * 0 + 7)
    fitted = toxicity.fit(["good", "bad"], [0, 1])
    runs = {
        "op1": exact_dedup.annotate, "op3": lambda d: toxicity.scored(d, fitted), "op4": sharding.shard, "op5": suffix_dedup.deduplicate, "op7": bpe.encode, "op8": tiff.documents, "op9": simhash.cluster, "op10": mixing.stream,
        "stage 3": lambda d: toxicity.reject(d, fitted).select("doc_id", "text"), "stage 1": lambda d: exact_dedup.deduplicate(d).select("doc_id", "text"), "stage 9": lambda d: simhash.deduplicate(d).select("doc_id", "text"), "stage 10": lambda d: mixing.mix(d).select("doc_id", "text"),
    }
    for name, run in runs.items():
        one, two = (sorted(map(str, run(d).collect())) for d in (plain, wide))
        assert one == two and one, name
