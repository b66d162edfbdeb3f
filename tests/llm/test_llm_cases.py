"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
import xxhash
from brute import align_score, least_reachable, simhash

from tallyline.llm import (
    chat,
    components,
    decontaminate,
    embedding_dedup,
    line_dedup,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash as sh,
    url_filter,
)
from tallyline.llm.queries import RULES, tokenizer_path

LONG = "word " * 60_000
DOCS = [
    (1, "alpha beta gamma delta"), (2, None), (None, "alpha beta gamma delta"), (3, ""), (4, LONG),
    (1, "alpha beta gamma delta"), (5, " \t\n"),
]
EXTRA = "id long, doc_id long, text string, t string, row string, h1 int, kept int, n_lines int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(9, d, t, "x", None, 1, 2, 3) for d, t in DOCS]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_line_dedup_cases(spark, docs, none):
    assert line_dedup.drop_shared_lines(none).count() == 0
    shared = "This line is shared by a good many documents."
    rows = [(k, f"own {k}\n  {shared.upper()}\t\nlast") for k in range(5)] + [(None, shared), (9, f"{shared}\n{shared}"), (9, shared), (10, None)]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept) for r in found)
    want = [(k, 3, 1, f"own {k}\nlast") for k in range(5)]
    assert kept == [(-1, 1, 1, ""), *want, (9, 1, 0, shared), (9, 2, 0, f"{shared}\n{shared}"), (10, 1, 0, "")]
    assert {c for r in line_dedup.drop_shared_lines(docs).collect() for c in r.row.asDict()} == set(docs.columns)


def test_line_hashes_are_of_the_key_under_two_seeds(spark):
    keys = ["a line", "another line", "É", ""]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    found = frame.select("k", *line_dedup.line_hashes(frame["k"])).collect()
    second = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), seed=42)
    for r in found:
        data = r.k.encode()
        assert (r.h1 % 2**64, r.h2 % 2**64) == (xxhash.xxh64_intdigest(data, seed=42), xxhash.xxh64_intdigest(data, seed=second))


def test_url_cases(spark):
    urls = [
        "HTTP://WWW.Example.COM/en/x?q", "https://example.com/en/", "http://a.b.net/fr/1#x", "http://net/es/", "x.com/en/",
        None, "", "http://com", "http://com/", "http://notexample.com/en/", "ftp://a.org:80/p://q", "http://a.spam-farm.x.org", "http://example.com/enx",
    ]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)] * 2, "page_id int, url string, host string, uid int")
    found = url_filter.judge_urls(pages, RULES).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(found) == 2 * len(urls)
    by = {r.page_id: tuple(r)[1:] for r in found}
    assert [by[k] for k in range(len(urls))] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
        ("a.b.net", "/fr/1", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("a.org:80", "/p://q", None, "allow"),
        ("a.spam-farm.x.org", "", None, "block"), ("example.com", "/enx", "com/", "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.judge_urls(pages, []).filter("verdict <> 'allow' or rule is not null").count() == 0


def test_vector_cases(spark):
    rng = np.random.default_rng(3)
    center = rng.normal(size=(6, 8))
    rows = [(int(k), [float(v) for v in center[k % 6] + rng.normal(size=8) * 0.25]) for k in range(700)]
    odd = [
        (1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [float("inf")] + [1.0] * 7),
        (1004, [None] + [1.0] * 7), (1005, [1.0] * 3), (1006, []), (3, rows[3][1]), (None, rows[3][1]), (2000, [2 * v for v in rows[3][1]]),
    ]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = embedding_dedup.near_vectors(frame).collect()
    sound = rows + [r for r in odd if r[0] in (3, None, 2000)]
    x = np.array([r[1] for r in sound])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [r[0] if r[0] is not None else 10**9 for r in sound]
    best = least_reachable(ids, linked)
    want = [(r[0], int(n), b) for r, n, b in zip(sound, linked.sum(1), best)]
    want += [(i, 0, i) for i, _ in odd if i is not None and 1000 <= i < 2000]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)
    assert linked.sum() > 10_000
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1000), (500, 700), (700, 600), (-5, 600)]
    found = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    want = {k: 0 for k in range(301)} | {500: -5, 600: -5, 700: -5, -5: -5}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_simhash_cases(docs, none):
    assert sh.near_groups(none).count() == 0
    found = sorted((r.id if r.id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in sh.near_groups(docs).collect())
    a, b = simhash("alpha beta gamma delta"), simhash(LONG)
    assert found == [(-1, a, 1), (1, a, 1), (1, a, 1), (2, 0, 2), (3, 0, 2), (4, b, 4), (5, 0, 2)]
    assert sh.fingerprint("One two") == simhash("One two") and sh.fingerprint("É SS x\u00a0y z") == simhash("É SS x\u00a0y z")


def test_vantage_point_tree_loses_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, size=400, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, size=(4, 2))]
    marks = np.unique(np.array([*map(int, base), *near], dtype=np.uint64))
    monkeypatch.setattr(sh, "SHARD_ROWS", 60)
    monkeypatch.setattr(sh, "TASK_ROWS", 50)
    frame = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.components(sh.near_pairs(frame, 2)).collect()}
    linked = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2
    best = least_reachable(marks.view(np.int64).tolist(), linked)
    assert [roots.get(m, m) for m in marks.view(np.int64).tolist()] == best


def test_packing_cases(docs, none):
    path = tokenizer_path()
    assert packing.pack(none, path).count() == 0
    found = packing.pack(docs, path, capacity=1000).collect()
    assert sum(r.length for r in found if r.id == 4) == 60_001 and sum(r.id == 4 for r in found) == 61
    assert sorted(r.length for r in found if r.id != 4) == [1, 1, 1, 5, 5, 5]
    assert len({r.sequence_id for r in found}) == 61


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 400))
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, size=60), rng.integers(1, 500, size=60))}
    plan = packing.Plan(dict(counts), capacity)
    used: dict[int, int] = {}
    for pattern, times in plan.patterns:
        assert sum(pattern) <= capacity and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_exact_complements_come_first():
    plan = packing.Plan({70: 1, 30: 1, 60: 1, 25: 1, 15: 1, 50: 1, 20: 2, 10: 1}, 100)
    assert sorted(sum(p) for p, _ in plan.patterns) == [100, 100, 100]


def test_decontamination_cases(spark, docs, none):
    item = "the quick brown fox jumps over a lazy dog while seven grey owls watch from an old oak tree near here".split()
    edited = list(item)
    edited[6] = "one"
    del edited[12]
    rows = [
        (1, "intro words here " + " ".join(item) + " and more"), (2, "Some TEXT: " + " ".join(edited).upper() + "!"), (3, " ".join(item[:6])),
        (4, None), (5, ""), (None, " ".join(item)), (6, LONG + " ".join(item)), (1, " ".join(item)), (7, "nothing of that kind"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, " ".join(item))], "item_id long, text string")
    found = {(r.id, r.item): r for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(found) == {(d, i) for d in (1, 2, None, 6) for i in (10, 13)}
    assert found[1, 10].score == 1 and found[6, 10].first_word == 60_000 and found[6, 10].end_word == 60_000 + len(item)
    assert found[2, 10].score == align_score(edited, item) / (2 * len(item)) < 1
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0


def test_decontamination_of_items_that_many_documents_hold(spark):
    """Over 64 word-for-word copies, over 64 documents of one edited version, and edits of their own, against brute force."""
    rng = np.random.default_rng(3)
    items = {f"i{k}": [f"q{k}w{j}" for j in range(36)] for k in range(2)}
    items["i2"] = list(items["i1"])
    edited = list(items["i0"])
    for at in (6, 7, 15, 24, 33):
        edited[at] = "other"
    texts = {}
    for k in range(100):
        around = [f"d{k}x{j}" for j in range(5)]
        texts[f"a{k}"] = around + items["i0"]
        texts[f"b{k}"] = around + edited
        texts[f"c{k}"] = around + [f"n{j}" if rng.random() < 0.2 else w for j, w in enumerate(items["i1"])]
        texts[f"d{k}"] = ["same", "words"] + edited

    def grams(words):
        return {tuple(words[j : j + decontaminate.GRAM]) for j in range(len(words) - decontaminate.GRAM + 1)}

    scores = {
        (d, i): align_score(words, item) / 72
        for d, words in texts.items()
        for i, item in items.items()
        if grams(words) & grams(item)
    }
    expected = {pair: score for pair, score in scores.items() if score >= 0.5}
    assert all(((f"{k}{n}", "i0") in expected) for k in "abd" for n in range(100))
    frame = spark.createDataFrame([(d, " ".join(words)) for d, words in texts.items()], "doc_id string, text string")
    bench = spark.createDataFrame([(i, " ".join(words)) for i, words in items.items()], "item_id string, text string")
    found = {(r.id, r.item): r.score for r in decontaminate.contaminated(frame, bench).collect()}
    assert found == pytest.approx(expected)


def test_decontamination_recall_and_a_common_phrase(spark):
    """Edited copies of prose items against the full alignment of every pair, a phrase that all items hold, and one very long item."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(400)]
    phrase = "what is the right answer to this question".split()
    items = {k: phrase + [str(w) for w in rng.choice(vocabulary, int(rng.integers(15, 60)))] for k in range(30)}
    items[99] = phrase + [str(w) for w in rng.choice(vocabulary, 3_000)]
    items[50] = list(phrase)
    texts = {}
    for k in range(200):
        words = list(items[k % 30])
        share = rng.uniform(0, 0.3)
        edited = [w if rng.random() > share else rng.choice(vocabulary) if rng.random() < 0.5 else None for w in words]
        texts[k] = [str(w) for w in rng.choice(vocabulary, 20)] + [w for w in edited if w] + [str(w) for w in rng.choice(vocabulary, 20)]
    texts[300] = items[99][500:2_500]
    texts[301] = ["some"] + phrase + ["more"]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.id, r.item): r.score for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, words in texts.items():
        for i, item in items.items():
            points, _, _ = decontaminate.align(words, item)
            if points >= len(item):
                want[d, i] = points / (2 * len(item))
    assert found.keys() <= want.keys() and len(found) >= 0.9 * len(want) and len(want) > 150
    assert all(found[pair] == pytest.approx(want[pair]) for pair in found) and {(300, 99), (301, 50)} <= found.keys()


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(40):
        item, passage = (["abcdef"[k] for k in rng.integers(0, 6, size=rng.integers(1, 30))] for _ in range(2))
        assert decontaminate.align(passage, item)[0] == align_score(passage, item)


def test_quality_cases(spark):
    good, bad = "calm words make a plain text about rivers", "BUY!! $$$ NOW!! %%% CHEAP!! ### DEALS!!"
    rows = [(k, (good if k % 2 else bad) + f" n{k % 7}", "en", "s", 40) for k in range(200)]
    rows += [(None, good, None, None, None), (900, None, None, "s", 0), (901, bad, "de", None, None), (901, bad, "de", None, None), (902, good * 2_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, y int")
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == len(rows)
    assert all(r.kept == bool(r.id % 2) for r in scored if r.id is not None and r.id < 200)
    assert [r.kept for r in scored if r.id == 901] == [False, False] and [r.kept for r in scored if r.id in (None, 902)] == [True, True]
    blank = quality.score_quality(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in blank} == {0.5} and all(r.kept for r in blank)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_chat_cases(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 2)
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"),
        (None, 0, None, "x"), (None, 0, None, "x"), (None, None, "zoe", "first"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv, r.speaker, r.part): r for r in chat.perspectives(frame).collect()}
    assert set(found) == {(1, s, p) for s in ("ann", "bob") for p in (0, 1)} | {(None, s, p) for s in ("unknown", "zoe") for p in (0, 1)}
    one = found[1, "ann", 0]
    assert one.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
    assert [one.rendered[s.start : s.end] for s in one.mask] == ["hi < |im_end|><|im_end|>"] and (one.n_turns, one.n_trained) == (2, 1)
    other = found[1, "bob", 1]
    assert other.rendered == "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=ann\nbye<|im_end|>\n"
    assert found[None, "zoe", 0].rendered.startswith("<|im_start|>assistant\nfirst")
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_chat_parts_begin_with_what_was_said_before(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 4)
    rows = [(1, 0, "system", "be kind")] + [(1, k, "ann" if k % 2 else "bob", f"m{k}") for k in range(1, 12)]
    frame = spark.createDataFrame(rows + [(2, 0, "ann", "a"), (2, 1, "bob", "b")], "conv_id long, turn long, role string, text string")
    found = {(r.conv, r.speaker, r.part): r for r in chat.perspectives(frame, context=2).collect()}
    assert {k[2] for k in found if k[0] == 1} == {0, 1, 2} and len(found) == 8
    one = found[1, "ann", 2]
    said = [m.split("\n", 1) for m in one.rendered.replace("<|im_start|>", "").split("<|im_end|>\n")[:-1]]
    assert said == [["system", "be kind"], ["user name=bob", "m6"], ["assistant", "m7"], ["user name=bob", "m8"], ["assistant", "m9"], ["user name=bob", "m10"], ["assistant", "m11"]]
    assert [one.rendered[s.start : s.end] for s in one.mask] == ["m9<|im_end|>", "m11<|im_end|>"] and (one.n_turns, one.n_trained) == (4, 2)
    assert sum(r.n_turns for (c, s, _), r in found.items() if (c, s) == (1, "ann")) == 12
    with pytest.raises(Exception, match="context"):
        chat.perspectives(frame, context=5)


def test_sharding_cases(spark, docs, none):
    grid = sharding.grid
    assert sharding.place(none, grid(8), grid(9)).count() == 0
    found = sharding.place(docs, grid(8), grid(9)).collect()
    assert len(found) == len(DOCS) and [r.size for r in found if r.id in (2, 3)] == [1, 1]
    assert len({r.shard for r in found if r.id == 1}) == 1 and len({r.slot for r in found if r.id == 1}) == 2
    keys = spark.range(4000)
    heavy = [sharding.Shard(k, f"r{k // 4}", f"k{k // 2}", 3.0 if k == 7 else 1.0) for k in range(8)]
    light = [sharding.Shard(k, f"r{k // 4}", f"k{k // 2}") for k in range(8)]
    rows = keys.select(sharding.descend(keys["id"], light).alias("a"), sharding.descend(keys["id"], heavy).alias("b")).collect()
    # Only rows that enter the changed region, or move inside it, change place.
    assert all(r.a == r.b or r.b >= 4 for r in rows)
    assert 0.24 < sum(r.b == 7 for r in rows) / len(rows) < 0.36


def test_secret_cases(spark):
    key = "a1B2c3D4e5F6a7B8c9D0"
    rows = [(k, f'some words token = "{key}{k:04d}" more words', "src/app.py") for k in range(40)]
    rows += [(100 + k, f"the number 98079157628044{k:02d} is a card and anotherVeryLongCompoundName too", None) for k in range(40)]
    rows += [(200, None, None), (201, "", "x"), (None, f'token = "{key}9999"', ""), (0, rows[0][1], rows[0][2]), (202, "x" * 100_000 + "1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.described(docs)
    secrets = secret_scan.scan_secrets(found, secret_scan.weak_label(found)).collect()
    assert {r.id for r in secrets} == {*range(40), None} and sum(r.id == 0 for r in secrets) == 2
    assert secret_scan.described(docs.limit(0)).count() == 0
    unlabelled = secret_scan.scan_secrets(found, secret_scan.weak_label(found).filter("label = 2")).collect()
    assert {r.score for r in unlabelled} == {0.5} and len(unlabelled) == found.count()
    empty = secret_scan.described(docs.limit(0))
    assert secret_scan.scan_secrets(empty, secret_scan.weak_label(empty)).count() == 0


def test_bare_keys_are_left_to_the_forest(spark):
    rng = np.random.default_rng(2)
    key = lambda: "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, size=40))
    rows = [(k, f'some words token = "{key()}" more words', "src/app.py") for k in range(60)]
    rows += [(100 + k, f"the number {4539578763621400 + k} is written here", "src/app.py") for k in range(300)]
    bare = [(1000 + k, f"they saw {key()} somewhere near", "src/app.py") for k in range(5)]
    found = secret_scan.described(spark.createDataFrame(rows + bare, "doc_id long, text string, source string"))
    labelled = secret_scan.weak_label(found)
    labels = {(r.id, r.label) for r in labelled.select("id", "label").collect()}
    assert {(k, None) for k, _, _ in bare} <= labels and 20 <= sum(label == 0 for _, label in labels) <= 40
    secrets = secret_scan.scan_secrets(found, labelled, without=secret_scan.CONTEXT).collect()
    assert {r.id for r in secrets} == {*range(60), *range(1000, 1005)}


def test_kinds_that_are_certain(spark):
    """Values given within a word and keys of a public form are true; addresses with parameters and plain names stay open or false."""
    rng = np.random.default_rng(5)
    hexa, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    rows = [(k, f"some words password={_random_text(rng, hexa, 17)}7 more", "s") for k in range(30)]
    rows += [(100 + k, f"some words AKIA{_random_text(rng, capitals, 16)} more", "s") for k in range(30)]
    rows += [(200 + k, f"some words {4539578763621400 + k} more", "s") for k in range(300)]
    rows += [(600, "see https://x.org/list?key=abcdefgh1234567890 now", "s"), (601, "key=windowwindowwindow now", "s"), (602, "ghp_" + _random_text(rng, capitals, 36), None)]
    found = secret_scan.described(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    label = {r.id: r.label for r in secret_scan.weak_label(found).select("id", "label").collect()}
    assert {k for k, v in label.items() if v == 1} == {*range(30), *range(100, 130), 602}
    assert label.get(600) is None and label.get(601) is None
    got = {r.id for r in secret_scan.scan_secrets(found, secret_scan.weak_label(found), planted=secret_scan.NEIGHBOURS).collect()}
    assert {*range(30), *range(100, 130), 602} <= got and not got & set(range(200, 500))


def _random_text(rng, letters, n):
    return "".join(letters[k] for k in rng.integers(0, len(letters), size=n))


@pytest.mark.parametrize("sent", [8 << 20, -1])
def test_planted_keys_and_look_alikes(spark, monkeypatch, sent):
    """Keys between plain words, and what looks like them: the forest decides by characters and by neighbours."""
    monkeypatch.setattr(secret_scan, "SENT_WORDS", sent)
    rng = np.random.default_rng(11)
    hexa, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["river", "stone", "market", "window", "garden", "letter", "summer", "paper", "morning", "number"]
    some = lambda: " ".join(words[k] for k in rng.integers(0, 10, size=4))
    key = lambda: _random_text(rng, *((hexa, 40) if rng.random() < 0.5 else (mixed, 32)))
    camel = lambda: "".join(words[k].capitalize() for k in rng.integers(0, 10, size=4))
    rows = []
    add = lambda base, n, make: rows.extend((base + k, f"{some()} {make()} {some()}", "src3") for k in range(n))
    # What labels are read from: given credentials, card numbers, names made of words, digests.
    add(0, 150, lambda: f'{rng.choice(["token", "password", "api_key"])} = "{key()}"')
    add(1000, 200, lambda: str(rng.integers(4 * 10**15, 5 * 10**15)))
    add(2000, 60, camel)
    add(3000, 120, lambda: f'commit {_random_text(rng, hexa, 40)}')
    # Those to be judged; the first, second and fourth kind have no label.
    add(10_000, 100, key)
    add(20_000, 60, lambda: str(rng.integers(10**15, 10**16)))
    add(21_000, 60, lambda: f"{camel()}{rng.integers(1, 10)}")
    add(22_000, 60, lambda: f"revision {_random_text(rng, hexa, 24)}")
    add(23_000, 60, lambda: "/".join(words[k] for k in rng.integers(0, 10, size=4)) + str(rng.integers(10)))
    found = secret_scan.described(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    labelled = secret_scan.weak_label(found)
    assert labelled.filter("id >= 10000 and id < 20000 and label is not null").count() == 0
    got = {r.id for r in secret_scan.scan_secrets(found, labelled, planted=secret_scan.NEIGHBOURS).collect()}
    true = {*range(150), *range(10_000, 10_100)}
    bare = [k for k in got if k >= 10_000]
    assert set(range(150)) <= got, [k for k in range(150) if k not in got]
    assert sum(k < 20_000 for k in bare) >= 0.9 * 100 and sum(k < 20_000 for k in bare) >= 0.9 * len(bare), sorted(bare)
    assert len(got & true) >= 0.9 * len(got)


def test_secret_fit_is_not_filled_by_copies(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FIT_ROWS", 20)
    rows = [(k, 'some words token = "a1B2c3D4e5F6a7B8c9D0" more words', "src/app.py") for k in range(50)]
    rows += [(100 + k, "the number 4539578763621486 is a card", "src/app.py") for k in range(50)]
    found = secret_scan.described(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    labelled = found.selectExpr("*", "if(id < 100, 1D, 0D) AS label")
    assert {r.id for r in secret_scan.scan_secrets(found, labelled).collect()} == set(range(50))


def test_vectors_of_every_length_are_compared(spark):
    rows = [(k, [1.0, k / 100, 0.0]) for k in range(3)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [2.0, -1.0]), (20, [1.0]), (21, [5.0]), (22, [-1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vec string, n_links int")
    found = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()}
    want = {0: (2, 0), 1: (2, 0), 2: (2, 0), 10: (1, 10), 11: (1, 10), 12: (0, 12), 20: (1, 20), 21: (1, 20), 22: (0, 22)}
    assert found == want


def test_pipeline_decides_by_rows(spark, tmp_path):
    """Repeated ids with different texts, and repeated rows: each stage keeps what it would keep under ids of their own."""
    import corpus_pipeline as pipeline

    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, words(1)), (1, words(2)), (2, words(2)), (3, words(1)), (3, words(3)), (3, words(3)), (None, words(4)), (4, words(4)), (None, words(5))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), 7) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int")
    kept = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in pipeline.one_of_each_group(spark, docs, "").collect())
    assert sorted(t for _, t in kept) == sorted(words(k) for k in range(1, 6)) and (1, words(1)) in kept and (3, words(3)) in kept
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, words(2))], "item_id long, text string").write.parquet(str(bench))
    clean = pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in clean) == sorted(t for _, t in rows if t != words(2)) and clean[0].__fields__ == docs.columns
    good, bad = "calm words make a plain text about rivers", "BUY!! $$$ NOW!! %%% CHEAP!! ### DEALS!!"
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) + f" n{k % 7}", "en", "s", 40) for k in range(200)] + [(300, good, "en", "s", 40), (300, bad, "en", "s", 40)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = pipeline.keep_good(spark, docs, str(tmp_path)).collect()
    assert [r.text for r in found if r.doc_id == 300] == [good] and len(found) == 101
