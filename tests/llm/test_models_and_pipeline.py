"""Language identification, quality classification, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioline.llm import language_id, quality, queries

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


def test_language_of_held_out_documents(spark):
    found = queries.op4_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 350
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(r.lang_pred == r.lang for r in held if r.n > 1000)


def test_profiles_do_not_depend_on_neighbours():
    texts = ["", "abc def", "x", "Änderung  im Text 7", "ABC DEF"]

    def of(own):
        data = [t.encode() for t in own]
        return language_id.profiles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))

    together, letters = of(texts)
    assert letters.tolist() == [False, True, True, True, True]
    for i, text in enumerate(texts):
        assert (of([text])[0][0] == together[i]).all()
    assert (together[1] == together[4]).all()


def test_language_edges(spark):
    rows = [
        (1, "the cat and the dog and the", "en"), (2, "le chat et le chien et le", "fr"), (3, None, "en"), (4, " 12!? ", "fr"),
        (5, "the dog", None), (None, "the", "en"), (5, "the dog", None), (6, "x" * 200_000, "en"), (7, "", "fr"), (8, "東京", "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, None, None, "s", "r") for i, t, lang in rows], SCHEMA)
    found = language_id.predict(docs, language_id.learn(docs)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["en", "fr", "und", "und", "en", "und"]
    assert by_id[3].score == by_id[4].score == 0.0 and by_id[1].row == "r"
    assert language_id.predict(docs, []).where("lang_pred != 'und' OR score != 0").count() == 0
    assert language_id.predict(docs.limit(0), language_id.learn(docs.limit(0))).collect() == []
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, None, 6, 8}


def test_quality_of_rows_kept_back(spark):
    found = queries.op10_quality_classifier(spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.doc_id // 7 % 4 == 0]
    assert len(held) > 50 and np.mean([r.keep == (r.quality == 1) for r in held]) > 0.95
    assert found.count() == 1000


def hinted(n=1200, known=200):
    """The page view alone knows a hint that few labelled rows show; the text view learns it."""
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, n)
    pages = np.stack([truth * 2 + 5, rng.integers(100, 110, n)], axis=1)
    dense = np.stack([truth + rng.normal(0, 0.8, n), rng.normal(0, 1, n)], axis=1)
    text = quality.View(np.zeros(0, np.int64), np.zeros(n + 1, np.int64), dense, 1 << quality.WORD_BITS)
    return (text, quality._page_view(pages)), truth, np.arange(known), np.arange(known, n)


def rows_of(views, rows):
    return tuple(view.take(rows) for view in views)


def test_views_teach_each_other():
    views, truth, known, pool = hinted()
    given = []

    def gather(models):
        sums = quality.empty_sums(models)
        quality.sure_sums(models, rows_of(views, pool), sums)
        chance = quality._sigmoid(models[1].log_odds(views[1]))[pool]
        given.append((sums[0].number.ravel().tolist(), [(chance <= 1 - quality.SURE).sum(), (chance >= quality.SURE).sum()]))
        return sums

    model = quality.co_train(rows_of(views, known), truth[known], known % 4 == 0, gather)
    score, text_score, page_score = model.score(views)
    # Every row that the page view is sure of is taken, however many there are.
    assert len(given) == quality.ROUNDS - 1 and all(took == sure and min(took) > 300 for took, sure in given)
    assert np.mean((score > 0.5) == truth) > 0.98 and np.mean((page_score > 0.5) == truth) > 0.98
    assert ((score >= 0) & (score <= 1)).all() and np.mean((text_score > 0.5) == truth) > 0.65


def test_sums_stand_for_their_rows():
    """The quadratic of the sums equals the rows' loss where it starts and is nowhere below it."""
    rng = np.random.default_rng(5)
    n = 40
    bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 9, n))])
    view = quality.View(rng.integers(0, 30, bounds[-1]), bounds, rng.normal(0, 2, (n, 3)), 30, rng.integers(1, 4, bounds[-1]).astype(float))
    model = quality.Logistic(view)
    model.sparse, model.dense, model.bias = rng.normal(0, 1, 30), rng.normal(0, 1, 3), 0.3
    label = rng.integers(0, 2, n)
    sums = quality.Sums.empty(30, 3)
    for rows in np.array_split(rng.permutation(n), 7):
        for kind in (0, 1):
            model.add_sums(view.take(rows[label[rows] == kind]), kind, sums)
    whole = quality.Sums.empty(30, 3)
    for kind in (0, 1):
        model.add_sums(view.take(np.flatnonzero(label == kind)), kind, whole)
    assert all((a == b).all() for a, b in zip(sums.parts(), whole.parts(), strict=True))
    weight = np.where(label > 0, 0.5 / (label > 0).sum(), 0.5 / (label == 0).sum())
    start = [model.sparse.copy(), model.dense.copy(), np.array([model.bias])]
    gradient = model.surrogate(sums, label[:0])

    def loss(parameters):
        model.sparse, model.dense, model.bias = parameters[0], parameters[1], float(parameters[2][0])
        raw = model.raw(view)
        return (weight * (np.logaddexp(0, raw) - label * raw)).sum()

    base, slope = loss(start), gradient(start)
    for size in (1e-4, 0.1, 1.0, 5.0):
        move = [rng.normal(0, size, len(p)) for p in start]
        moved = [p + m for p, m in zip(start, move, strict=True)]
        # A quadratic's rise is its mean slope along the way.
        rise = sum(((a + b) / 2 * m).sum() for a, b, m in zip(slope, gradient(moved), move, strict=True))
        assert loss(moved) <= base + rise + 1e-4
    step = [rng.normal(0, 1e-4, len(p)) for p in start]
    change = loss([p + s for p, s in zip(start, step, strict=True)]) - loss([p - s for p, s in zip(start, step, strict=True)])
    assert change / 2 == pytest.approx(sum((g * s).sum() for g, s in zip(slope, step, strict=True)), abs=1e-7)


def test_learning_equals_plain_numpy(spark):
    """The model of whole tables is the one of the same co-training over all rows in memory."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    rows = quality._input(docs).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    parts = [views for *_, views in quality._pieces(rows)]
    text = quality.View(
        np.concatenate([t.buckets for t, _ in parts]),
        np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.bounds) for t, _ in parts]))]),
        np.concatenate([t.dense for t, _ in parts]), 1 << quality.WORD_BITS,
    )
    page = quality._page_view(np.concatenate([p.buckets.reshape(-1, 3) for _, p in parts]))
    ids = np.array(rows.column("doc_id").to_pylist())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known, pool = (np.flatnonzero([(i in truth) == k for i in ids]) for k in (True, False))

    def gather(models):
        sums = quality.empty_sums(models)
        quality.sure_sums(models, rows_of((text, page), pool), sums)
        return sums

    plain = quality.co_train(
        rows_of((text, page), known), np.array([truth[i] for i in ids[known]]), ids[known] // 7 % 4 == 0, gather
    )
    for ours, theirs in zip(model.score((text, page)), plain.score((text, page)), strict=True):
        assert np.abs(ours - theirs).max() < 1e-6
    seen = quality.gather_sums(docs, list(model.views), ids[known])
    want = quality.empty_sums(list(model.views))
    quality.sure_sums(list(model.views), rows_of((text, page), pool), want)
    for a, b in zip(seen, want, strict=True):
        assert all((x == y).all() for x, y in zip(a.parts(), b.parts(), strict=True))
        shuffled = quality.gather_sums(docs.repartition(5, "n_chars"), list(model.views), ids[known])
    for a, b in zip(seen, shuffled, strict=True):
        assert all((x == y).all() for x, y in zip(a.parts(), b.parts(), strict=True))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_quality_edges(spark, labels):
    rows = [(1, "a text", "en", "s", 6), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x", "en", "s", 1), (1, "a text", "en", "s", 6)]
    docs = spark.createDataFrame([(*r, "sc", "r") for r in rows], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.score(docs, quality.learn(docs, known)).collect()
    share = np.mean([q for _, q, _ in labels]) if labels else 0.5
    assert len(found) == len(rows) and all(r.score == share for r in found)
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), known)).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(
        [(900_001, "12 ?", "en", "src1", 4), (900_002, None, "en", "src1", 0), (900_003, "alpha beta gamma", "en", "src1", 16)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    given = docs.unionByName(extra.select(docs.columns))
    columns, before = given.columns, given.count()
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.written(stage(spark, given, SMALL), name)
        if name != "best_fit_packing":
            assert path.columns == columns and path.schema.simpleString() == docs.schema.simpleString()
            assert 0 < path.count() <= before
            before = path.count()
        if name == "language_id":
            assert {r.doc_id for r in given.join(path, "doc_id", "left_anti").collect()} == {900_001, 900_002}
        given = path
    assert given.select("doc_id").distinct().count() == before
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "substring_dedup", "source_mixing", "best_fit_packing"
    ]


CLASHING = ["score", "lang_pred", "row", "row_key", "n_words", "n_removed", "whole", "spans", "domain", "component_id", "place"]


def test_stages_leave_further_columns_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    # A row without id, and an id with two texts, of which one is long.
    long = " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
    extra = [(None, "some other words here", "en", "src1", 21), (7_000_001, "short text", "en", "src1", 10), (7_000_001, long, "en", "src1", len(long))]
    rows = spark.createDataFrame([(*r, *CLASHING) for r in extra], ", ".join([docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), *[f"{c} string" for c in CLASHING]]))
    given = given.unionByName(rows.select(given.columns))
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.written(stage(spark, given, SMALL), name)
        assert path.count() > 0
        if name != "best_fit_packing":
            assert path.schema.simpleString() == given.schema.simpleString()
            for row in path.where("doc_id < 7000000").collect():
                assert all(row[c] == f"{c}:{row.doc_id}" for c in CLASHING)
            if name != "source_mixing":
                assert {r.n_chars for r in path.where("doc_id = 7000001").collect()} == {10, len(long)}
        given = path


def test_the_learners_share_of_any_table(spark):
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    for rows in (1, 20_000, 30_000, 10**8, 10**11, 10**14):
        share = min(1.0, language_id.TRAINING_ROWS / rows)
        bound = max(1, int(share * 2**62))
        assert 0 < bound and abs(bound / 2**62 - share) <= 1e-9 * share + 2**-62
        assert ids.where(language_id._drawn(share)).count() == 2000 if share == 1 else True
    assert 800 < ids.where(language_id._drawn(0.5)).count() < 1200


def test_no_language_to_learn(spark):
    rows = [(1, "some words", None, "s", 10), (2, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_known_languages(spark, docs, "").count() == 2


def test_run_equals_the_stages_and_handles_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() >= found.select("doc_id").distinct().count() > 100
