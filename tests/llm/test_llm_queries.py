"""Registered queries over whole small tables against SQL or a plain version."""

import array
import collections
import zlib

import numpy as np
import pytest
from brute import least_reachable, rows, simhash
from compare import connect, differences

from tallyline.llm.packing import encoder
from tallyline.llm.queries import ORACLE, QUERIES, tokenizer_path


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


def test_near_vectors(spark, sf_dir):
    data = rows(spark, sf_dir, "embeddings", "vec_id", "embedding")
    ids = [r[0] for r in data]
    x = np.array([r[1] for r in data], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    roots = least_reachable(ids, linked)
    want = {(i, int(n), r, i == r) for i, n, r in zip(ids, linked.sum(1), roots)}
    found = QUERIES["op2_embedding_dedup"](spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(data)


def test_simhash(spark, sf_dir):
    data = rows(spark, sf_dir, "documents", "doc_id", "text")
    marks = np.array([simhash(t) for _, t in data], dtype=np.uint64)
    linked = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2
    roots = least_reachable([d for d, _ in data], linked)
    want = {(d, f"{int(m):016x}", r) for (d, _), m, r in zip(data, marks, roots)}
    found = QUERIES["op7_simhash"](spark, sf_dir).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(data)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    want, total = {}, 0
    for doc, text in rows(spark, sf_dir, "documents", "doc_id", "text"):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[doc, piece] = (start, len(own), zlib.crc32(array.array("I", own).tobytes()))
    found = QUERIES["op4_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    assert len(found) == len(want)
    places = collections.defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-total // 4096) + 1


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [
        "It's ÉCOLE, naïve... don't!! <|endoftext|> <|start", "ß²³ µ ªº ÷× İstanbul ΣΑΣ", "a\u0301e\u0301 \u0301x",
        "x\x1cy\x85z\u2028w\u00a0v", "%%% 'S'll 12,5% a_b __", "word'sword they'Re", "日本語 text 😀😀", "",
    ]
    for text in texts:
        want = b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
        assert encoder(tokenizer_path()).encode(text) == want, text


def test_sharding(spark, sf_dir):
    texts = dict(rows(spark, sf_dir, "documents", "doc_id", "text"))
    found = QUERIES["op8_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_contamination_holds_every_item_found_word_for_word(spark, sf_dir):
    from tallyline.llm.decontaminate import words_of

    items = [(i, " ".join(words_of(t))) for i, t in rows(spark, sf_dir, "benchmark", "item_id", "text")]
    want = {
        (d, i) for d, t in rows(spark, sf_dir, "documents", "doc_id", "text")
        for text in [" ".join(words_of(t))] for i, item in items if f" {item} " in f" {text} "
    }
    found = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    assert want and want <= found


def test_quality_on_held_out_labels(spark, sf_dir):
    """Fitted on the rows of even id, held against the others."""
    from pyspark.sql import functions as F

    from tallyline.llm.quality import score_quality
    from tallyline.llm.queries import training_labels

    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = training_labels(spark, folder)
    scored = score_quality(docs, labels.filter("doc_id % 2 = 0")).withColumnRenamed("id", "doc_id")
    right = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").select(
        F.avg((F.col("kept") == (F.col("y") == 1)).cast("double")), F.count("*")
    )
    accuracy, n = right.first()
    assert n > 500 and accuracy > 0.95


def test_secrets_are_found(spark, sf_dir):
    import re

    folder = sf_dir.replace("sf0.001", "sf0.01")
    want = [
        (d, m) for d, t in rows(spark, folder, "documents", "doc_id", "text")
        for m in re.findall(r'token = "([0-9a-f]{40})"', t or "")
    ]
    found = [(r.doc_id, r.candidate) for r in QUERIES["op10_secret_scan"](spark, folder).collect()]
    assert want and set(want) <= set(found)
    # Hardly anything else is: card numbers, addresses and long words are removed.
    assert len(found) <= 1.2 * len(want)


def test_native_plans(spark, sf_dir):
    for name in ("op6_chat", "op10_secret_scan"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == first.columns, name
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left
    gone = {r.doc_id for r in first.select("doc_id").collect()} - left
    leaks = {r.doc_id for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    assert leaks <= gone and 0 < len(gone) < len(left)
