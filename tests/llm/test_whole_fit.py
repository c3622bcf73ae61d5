"""The latent space of decontamination is fitted on every passage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import helpers as H
from tracewell.llm import decontaminate as D
from tracewell.llm.textops import tokenize


@pytest.mark.parametrize("some", [2, 5, 8192])
def test_gram_of_passages(monkeypatch, some):
    """Equal to dense arithmetic over all passages, for texts of any length, whatever number of halves goes together."""
    monkeypatch.setattr(D, "HALVES", some)
    rng = np.random.default_rng(4)
    size = [0, 1, 15, 16, 17, 0, 32, 33, 48, 49, 100, 1, 300]
    bounds = np.cumsum([0, *size])
    h = rng.integers(0, 40, bounds[-1]).astype(np.uint64) * np.uint64(7)
    idf, basis = rng.uniform(0.5, 2, D.DIMS), rng.standard_normal((D.DIMS, 6)).astype(np.float32)
    at, n = D.halves(h, bounds)
    of, first, last = D._windows(bounds, D.WINDOW, D.WINDOW // 2)
    assert D.passage_count(n) == len(of)
    x = np.stack([np.bincount((h[s:e] % np.uint64(D.DIMS)).astype(int), minlength=D.DIMS) * idf for s, e in zip(first, last)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    total = np.zeros((D.DIMS + 1, 6))
    D.add_gram(at, n, idf, np.r_[idf[:, None] * basis, np.zeros((1, 6))].astype(np.float32), total)
    assert np.allclose(idf[:, None] * total[:-1], x.T @ (x @ basis), atol=1e-4)


def test_scattered_rows():
    rng = np.random.default_rng(5)
    values, at = rng.standard_normal((500, 3)), np.minimum(rng.geometric(0.1, (500, 4)) - 1, 19)
    for few in (0, 3, 64):
        want, got = np.ones((20, 3)), np.ones((20, 3))
        for row in at.T:
            np.add.at(want, row, values)
        D.scatter_rows(values, at, got, few)
        assert np.allclose(got, want)


def test_space_of_more_passages_than_a_sample_held(spark):
    """Every one of 40,000 passages counts: the singular values are those of all."""
    r = random.Random(6)
    texts = [" ".join(f"w{i % 8 * 100 + r.randrange(40)}" for _ in range(12)) for i in range(40_000)]
    space = D.fit_space(H.docs(spark, list(enumerate(texts))).select("text"), [], 64)
    names, of = np.unique((tokenize(texts).hashes % np.uint64(D.DIMS)).astype(int), return_inverse=True)
    tf = np.zeros((len(texts), len(names)))
    np.add.at(tf, (np.repeat(np.arange(len(texts)), 12), of), 1)
    x = tf * np.log((len(texts) + 2) / (tf.sum(0) + 1)).clip(0.05)
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = np.sqrt(np.linalg.eigvalsh(x.T @ x)[::-1])
    assert np.allclose(space.values[:8], exact[:8], rtol=1e-2)


def test_pipeline_keeps_every_passage_for_the_fit(spark, monkeypatch, tmp_path):
    """The pipeline's step fits its space on all of 40,000 passages."""
    kept, keep = [], D.keep
    monkeypatch.setattr(D, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(12)), "en", "web", 0) for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {x.doc_id for x in left.select("doc_id").collect()} == set(range(40_000)) - {5}
    assert sum(D.passage_count(np.frombuffer(x["size"], np.int32)) for x in kept[0].collect()) == 40_000
