"""Every stage of the pipeline against brute force on its own input."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers as H
from tracewell.llm.decontaminate import lcs_length
from tracewell.llm.packing import default_tokenizer
from tracewell.llm.quality import score_quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    item = H.prose(40, 900)
    rows = []
    for i in range(160):
        w = H.prose(90, i if i % 5 else 0, 3000).split()
        if i % 5 == 0:
            w[r.randrange(90)] = f"x{i}"
        if i % 40 == 7:
            w[20:20] = item.split()
        if i % 4 == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 18]) for k in range(0, len(w), 18)), "en", "web", 0))
    rows += [(500, None, "en", "web", 0), (501, "", "en", "web", 0), (None, rows[3][1], "en", "web", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(160)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        given, kept = [(x.doc_id, x.text) for x in before.collect()], docs.toPandas()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            ids = sorted(-1 if pd.isna(i) else int(i) for i in kept.doc_id)
        if name == "quality_classifier":
            scored = score_quality(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
            assert ids == sorted(-1 if x.doc_id is None else x.doc_id for x in scored.select("doc_id").collect())
        elif name == "line_dedup":
            want = {i: t for i, t in H.lines([(i, t) for i, t in given if i is not None and t])}
            gone = {i for i, t in want.items() if not H.words(t) and H.words(dict(given)[i])}
            assert ids == sorted(-1 if i is None else i for i, _ in given if i not in gone)
            assert all(x.text == want[x.doc_id] for x in docs.where("text <> '' and doc_id is not null").collect())
        elif name == "near_dedup":
            groups = H.near([(i, t) for i, t in given if i is not None])
            assert [i for i in ids if i >= 0] == sorted(i for i, (_, c) in groups.items() if i == c)
        elif name == "decontamination":
            item = H.words(H.prose(40, 900))
            leaked = {i for i, t in given if lcs_length(H.words(t, True), item) >= 0.7 * len(item)}
            assert ids == sorted(-1 if i is None else i for i, _ in given if i not in leaked)
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(default_tokenizer())
            want = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in given)
            assert kept.length.sum() == want and np.all(kept.groupby("sequence_id").length.sum() <= 2048)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "start"] and out.agg(F.sum("length")).first()[0] > 0
