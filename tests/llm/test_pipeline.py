"""Each stage of the corpus pipeline against brute force on its own input."""

import hashlib
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import byte_bpe, mixing, secrets
from tests.llm.frames import frame
from tests.llm.test_simhash import brute_links, plain_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    base = [rng.choices(words, k=rng.randint(60, 200)) for _ in range(150)]
    rows, labels = [], []
    for i in range(400):
        w = list(base[i % 150])
        if i % 8 == 0:
            w[3:3] = ["schuft", "nitwit"]
        if i % 10 == 3:
            w.append("token = abcdefghijklmnop")
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(900, None, None, None, None), (901, "", "en", None, 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    frame(spark, rows, extra=False).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    outs, inputs = [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/out{i}")
        docs = spark.read.parquet(f"{folder}/out{i}")
        outs.append(docs)
    rows = [{r.doc_id: r for r in o.collect()} for o in outs[:3]]

    assert set(rows[0]) == {i for i in before if i >= 400 or i % 8}
    fp = {i: plain_fingerprint(r.text, 4) for i, r in rows[0].items()}
    root = brute_links(list(fp.values()))
    low = {}
    for i, x in fp.items():
        low[root[x]] = min(low.get(root[x], i), i)
    assert outs[1].count() == len(low) and set(rows[1]) == set(low.values())

    plain = re.compile(secrets.ASSIGN)
    for i, r in rows[2].items():
        text = rows[1][i].text
        want = None if text is None else plain.sub(secrets.MASK, text)
        assert r.text == want
        assert r.n_chars == (rows[1][i].n_chars if want == text else len(want))

    taken = {r.doc_id: r.taken // r["size"] for r in mixing.plan(inputs[3]).filter("taken > 0").collect()}
    got = {r.doc_id: r["count"] for r in outs[3].groupBy("doc_id").count().collect()}
    assert got == taken
    assert outs[3].join(outs[2], ["doc_id", "text"], "left_anti").count() == 0

    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(
        corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)))}
    enc = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    mixed = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in outs[3].collect())
    assert sorted((r.doc_id, r.ids) for r in outs[4].collect()) == mixed
    assert outs[4].filter(F.col("n_tokens") != F.size("ids")).count() == 0

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, outs[4].collect()))


def test_last_stage_decodes(spark):
    """The digest is that of the bytes the ids decode to, the whole text."""
    texts = {1: "plain words", 2: "délta \U0001f600\n\t x", 3: "", 4: None}
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in texts.items()], extra=False)
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
