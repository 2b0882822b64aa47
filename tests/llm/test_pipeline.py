"""The five stages on planted documents, each judged on its own input."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdeghilmnorstu", k=rng.randrange(3, 9)))
    sentence = lambda: " ".join(word() for _ in range(8)).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    rows = [[i, text(10), "en", f"s{i % 3}"] for i in range(1600)]
    toxic = {i for i in range(1600) if i % 5 == 3}
    for i in toxic:
        words = rows[i][1].split(" ")
        for _ in range(4):
            words.insert(rng.randrange(len(words)), "vex" + word())
        rows[i][1] = " ".join(words)
    # too short for the line stage, so the copy is left for the near-duplicate stage
    passage, item, short = text(9), text(4), text(1)
    for i in (10, 20, 30, 40):
        rows[i][1] = rows[i][1][:99] + " " + passage + " " + rows[i][1][99:]
    rows[50][1] += " " + item
    rows += [[5000, rows[1][1], "en", "s0"], [5001, short, "en", "s0"], [5006, short, "en", "s0"], [5002, None, "en", None], [5003, "", "en", ""]]
    rows = [(*r, len(r[1] or ""), "more") for r in rows]
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(1600)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, toxic, passage


def test_stages_in_order(spark, folder):
    at, toxic, passage = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{at}/{len(seen)}"
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "SentencePiece encoding":
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    clean = set(range(1600)) - toxic
    after = seen[names[0]]
    assert len(clean & set(after)) >= 0.95 * len(clean)
    assert {5002, 5003} <= set(after)
    after = seen[names[1]]
    inner = ". ".join(passage.split(". ")[3:7])
    assert sum(inner in (r.text or "") for r in after.values()) == 1
    assert 5000 not in after and all(r.n_chars == len(r.text or "") for r in after.values())
    assert (1 in seen[names[0]]) == (1 in after)
    assert {5001, 5006} <= set(after) and {5001, 5006} & set(seen[names[2]]) == {5001}
    assert 50 not in seen[names[3]] and set(seen[names[3]]) | {50} >= set(seen[names[2]])
    assert set(seen[names[4]]) == set(seen[names[3]]) and all(r.lossless for r in seen[names[4]].values())


@pytest.mark.xfail(reason="known limit: from a few hundred texts of random words the network learns the texts, not the marked words")
def test_toxic_documents_go(spark, folder):
    at, toxic, _ = folder
    name, stage = corpus_pipeline.STAGES[0]
    left = {r.doc_id for r in stage(spark, spark.read.parquet(f"{at}/documents.parquet"), at).select("doc_id").collect()}
    assert len(toxic & left) <= 0.1 * len(toxic)


def test_run_equals_its_stages(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    want = sorted((r.doc_id, r.pieces) for r in docs.collect())
    assert sorted((r.doc_id, r.pieces) for r in corpus_pipeline.run(spark, at).collect()) == want


def test_columns_named_like_those_of_the_operators_are_kept(spark, folder):
    at, *_ = folder
    names = ["__items", "__walked", "__doc", "__gone", "__lines", "__id"]
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id % 9 = 1").selectExpr("*", *(f"doc_id + {k} AS {n}" for k, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert all(r[n] == r.doc_id + k for r in out.collect() for k, n in enumerate(names)), name
