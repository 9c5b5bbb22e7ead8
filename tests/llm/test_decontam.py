"""Contaminated words against a comparison of every window with every place."""

import random
import re

import numpy as np

from factweave.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, pattern in items:
            w = words(pattern)
            size = min(window, len(w))
            known = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w and item is not None else set()
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in known:
                    hit |= set(range(k, k + size))
                    ids.add(str(item))
        out.append((-1 if doc is None else doc, len(own), sorted(hit), sorted(ids)))
    return sorted(out)


def found(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [k for s in r.spans for k in range(s.a, s.b)], r["items"]) for r in frame.select("doc_id", "n_words", "spans", "items").collect())


def made(seed):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice("the of and a b c to in é 中文 x1 42".split()) for _ in range(n))
    items = [(k, pick(rng.choice([1, 2, 3, 7, 9, 10, 11, 25, 60]))) for k in range(3, 25)]
    docs = []
    for d in range(60):
        text = pick(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            text += rng.choice([" ", ", ", "\n", "--"]) + " ".join(w[a : a + rng.randrange(5, 20)]).upper() + " " + pick(4)
        docs.append((d, text))
    return docs, items


def test_equals_brute_force_in_any_number_of_blocks(spark):
    docs, items = made(1)
    docs += [(None, items[7][1]), (60, None), (61, ""), (61, "..."), (3, docs[4][1]), (3, docs[4][1]), (62, items[9][1] * 50)]
    items += [(None, "lost"), (90, None), (91, "- -"), (5, items[0][1]), (92, items[3][1]), (92, items[3][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, items int")
    assert found(decontam.contaminated(frame, bench)) == brute(docs, items)
    assert found(decontam.contaminated(frame, bench, block_bytes=300)) == brute(docs, items)
    assert found(decontam.contaminated(frame, bench, window=4)) == brute(docs, items, 4)
    assert found(decontam.contaminated(frame, bench.limit(0))) == brute(docs, [])
    assert found(decontam.contaminated(frame.limit(0), bench)) == []


def test_odd_rows_and_long_items(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [("a", rows[0][1]), ("b", " ".join(f"w{i % 977}" for i in range(9_000))), ("c", "a")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert found(decontam.contaminated(odd, bench)) == brute(rows, items)


def test_pieces_of_a_long_text(monkeypatch):
    docs, items = made(2)
    text = " ".join(t for _, t in docs) + "中" * 300
    patterns = decontam.Patterns([(str(k), t) for k, t in items], 10)
    data = np.frombuffer(text.encode(), np.uint8)
    before, rows = decontam._scan(patterns, data, np.array([0, len(data)]))
    monkeypatch.setattr(decontam, "PIECE", 64)
    n, pieces = decontam._long(patterns, data, 10)
    assert n == before[1] == len(words(text)) and sorted(pieces) == sorted(rows) and len(rows) > 50


def test_positions_are_skipped():
    windows = [" ".join(f"p{k}{j}" for j in range(10)).encode() for k in range(50)]
    table = decontam.Shifts(windows, 10)
    hashes = np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    looked = []
    slot = table._slot
    table._slot = lambda names: (looked.append(len(names)), slot(names))[1]
    assert not len(table.search(decontam.block_names(hashes, 2), np.array([9]), np.array([10_000])))
    assert sum(looked) < 2_500
