import numpy as np
from pyspark.sql import functions as F

from pressdesk.llm import quality as Q
from pressdesk.llm.queries import QUERIES


def test_held_out(spark, sf_dir):
    scored = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_context_vectors_by_definition(spark):
    texts = ["one two three two", "two ### Two TWO six", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    index, expected = Q.index_vectors().astype(int), np.zeros((Q.SLOTS, Q.DIM))
    for text in texts:
        words = (text or "").encode().split()
        slots = [Q._slot(w) for w in words]
        slots = [Q.AGAIN if i and s >= Q._OWN and s == slots[i - 1] else s for i, s in enumerate(slots)]
        for i, s in enumerate(slots):
            for j in range(max(0, i - Q.REACH), min(len(slots), i + Q.REACH + 1)):
                if j != i:
                    expected[s] += index[slots[j]]
    assert np.array_equal(Q.context_vectors(docs), expected)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (None, 1, 0), (8, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    docs = odd.select("doc_id", "text")
    scored = Q.classify(docs, labels, F.lit(True)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in Q.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert {r.score for r in Q.classify(docs, labels.filter("doc_id = 1"), F.lit(True)).collect()} == {1.0}
    assert Q.classify(none.select("doc_id", "text"), labels, F.lit(True)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, Q.DIM)), rng.integers(0, 2, 300)
    net = Q.Network(x, y, epochs=1)

    def loss():
        z = net._logits(x)
        decay = 0.5e-4 * ((net.parts[0] ** 2).sum() + (net.parts[2] ** 2).sum())
        return np.logaddexp(0, -np.where(y > 0, 1, -1) * z).mean() + decay

    for part, gradient in zip(net.parts, net._gradients(x, y)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - gradient[at]) < 1e-4
        part[at] += 1e-5


def test_an_id_counts_once_in_the_sample(spark, monkeypatch):
    """Many texts and labels of one id add one row; the sample holds no more rows than labelled ids."""
    rows = [(1, f"text number {i} of the same id") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, k % 2) for k in range(50)] + [(i, i % 2) for i in range(2, 40)],
                                   "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(Q, "Network", lambda x, y: sizes.append((len(x), float(y.sum()))))
    Q.fit(Q.features(docs, Q.word_vectors(Q.context_vectors(docs))), labels, F.lit(True))
    assert sizes == [(39, 1 + 19.0)]
