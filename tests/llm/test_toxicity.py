import numpy as np

from gradus.llm import toxicity


def test_ordinal_fit_climbs_to_the_maximum():
    rng = np.random.default_rng(3)
    n, m = 600, 8
    x = (rng.random((n, m)) < 0.4).astype(float)
    w = np.array([2.0, -1.5, 1.0, 0, 0, 0.5, 0, 0])
    y = ((x @ w + rng.logistic(size=n))[:, None] > np.array([0.5, 2.0])).sum(axis=1)
    r, c = np.nonzero(x)
    got, th = toxicity.fit_ordinal(r, c, x[r, c], m, y, np.ones(n), steps=800, penalty=0.0)

    def loss(w_, t_):
        up = 1 / (1 + np.exp(t_[None, :] - (x @ w_)[:, None]))
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        return -np.log(full[np.arange(n), y] - full[np.arange(n), y + 1]).mean()

    assert th[0] < th[1] and np.abs(got - w).max() < 0.6
    best = loss(got, th)
    for d in rng.standard_normal((40, m + 2)) * 0.02:
        assert loss(got + d[:m], th + d[m:]) >= best - 1e-4


def labelled(make, rng):
    rows, labels = [], []
    for i in range(600):
        n = (0, 1, 3, 6)[i % 4]
        words = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(30)] + rng.sample(["nasty", "scummy", "vileman", "vilegit", "vilepig", "viledog", "vilecow"], n)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(n > 0), n))
    return rows, labels


def test_severity_follows_the_words(spark, make, rng):
    rows, labels = labelled(make, rng)
    docs = make(rows)
    l = spark.createDataFrame(labels, "doc_id long, grade int, n int")
    model = toxicity.fit(docs, toxicity.sample_labels(l.where("doc_id % 3 <> 1").select("doc_id", "grade")), severity_levels=3)
    got = {r.doc_id: r for r in toxicity.predict(docs, model, keep=["doc_id"]).collect()}
    test = [(i, n) for i, _, n in labels if i % 3 == 1]
    assert np.mean([got[i].toxic == (n > 0) for i, n in test]) > 0.9
    mean = [np.mean([got[i].expected_severity for i, n in test if n == k]) for k in (0, 1, 3, 6)]
    assert mean == sorted(mean) and mean[0] < 0.3 and mean[3] > 1.5
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()


def test_odd_rows(spark, make, rng, odd_rows):
    rows, labels = labelled(make, rng)
    odd = [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in odd_rows]
    l = spark.createDataFrame([(i, g) for i, g, _ in labels] + [(1001, 1), (1003, 1), (None, 1), (1004, None)], "doc_id long, grade int")
    docs = make([r + ("x",) for r in rows + odd], ", grade string")
    model = toxicity.fit(docs, toxicity.sample_labels(l))
    out = toxicity.predict(docs, model)
    assert dict(out.dtypes)["grade"] == "int" and out.count() == len(rows) + len(odd)
    for r in out.where("text is null or text = ''").collect():
        assert (r.expected_severity, r.grade, r.toxic) == (0.0, 0, False)
    assert len({(r.expected_severity, r.grade) for r in out.where("doc_id = 1001").collect()}) == 1
    assert toxicity.predict(make([]), model).count() == 0
    assert toxicity.fit(docs, toxicity.sample_labels(l.where("false"))) is None
    assert toxicity.fit(docs, toxicity.sample_labels(l.where("grade = 0"))) is None
    assert toxicity.sample_labels(l, rows=10).groupBy("grade").count().agg({"count": "max"}).first()[0] == 10


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic as grade")
    model = toxicity.fit(docs, toxicity.sample_labels(labels.where("doc_id % 2 = 0")), severity_levels=3)
    p = toxicity.predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).join(labels.withColumnRenamed("grade", "y").where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.toxic for r in p if r.y == 0) <= 0.005 * sum(r.y == 0 for r in p)
    assert sum(r.toxic for r in p if r.y == 1) >= 0.9 * sum(r.y for r in p)
