"""Spelling variants against all strings one edit away, made one by one."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factweave.llm import queries as Q
from factweave.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=6, damaged=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damaged == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def around(word, letters):
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in letters}
    made |= {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in letters}
    return made - {word}


def grouped(rows, least=6, count=5, ratio=5, damaged=199):
    n = {w: c for w, c in counted(rows, least, damaged).items() if c >= count}
    letters = {x for w in n for x in w}
    near = {w: [x for x in around(w, letters) if x in n] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def found(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_equals_brute_force(spark, sf, texts):
    assert found(Q.QUERIES["op11_spelling"](spark, sf)) == grouped(texts)


def test_chains_ties_and_other_letters(spark):
    rows = [(1, "Banana " * 200), (2, "bananna " * 30 + "banannas " * 5 + "bananá " * 12), (3, "banama banama banaxa " * 9), (None, "ÀÉÎÖÜß×÷ÿ " * 7 + "ÀÉÎÖÜß×÷ " * 6), (4, None), (5, ""), (6, "short words ab " * 50), (3, "aaaaaaa " * 6 + "aaaaaa " * 31)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spelling.variant_groups(frame, damaged=10**9 + 7))
    assert got == grouped(rows, damaged=10**9 + 7)
    assert got["banannas"][:2] == ("bananna", "banana") and got["aaaaaaa"][0] == "aaaaaa"
    assert found(spelling.variant_groups(frame, damaged=3, count=1)) == grouped(rows, damaged=3, count=1)


def test_pieces_of_long_texts_and_odd_rows(spark, odd, none):
    text = ("çalibré Straße naïveté " * 40 + "中文" * 50 + "x" * 3000 + " words-and-more ") * 30
    data = np.frombuffer(text.encode(), np.uint8)
    seed = np.array([zlib.crc32(b"7:")], np.uint32)
    whole = spelling.words_of(data, np.array([0, len(data)]), seed).to_pylist()
    parts = list(spelling._pieces(data, 100))
    assert b"".join(p.tobytes() for p in parts) == data.tobytes() and len(parts) > 100
    assert [w for p in parts for w in spelling.words_of(p, np.array([0, len(p)]), seed).to_pylist()] == whole
    assert Counter(whole) == counted([(7, text)])
    assert found(spelling.variant_groups(none)) == {}
    long = spark.createDataFrame([(7, text * 40), (8, "straße straßen " * 9)], "doc_id long, text string")
    assert found(spelling.variant_groups(long)) == grouped([(7, text * 40), (8, "straße straßen " * 9)])
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spelling.variant_groups(odd.withColumnRenamed("_hit", "word"))) == grouped(rows)


@pytest.mark.parametrize("size", [6, 7, 9])
def test_no_neighbour_twice_and_none_missing(size):
    letters = np.frombuffer(b"abc", np.uint8)
    rng = np.random.default_rng(size)
    chars = letters[rng.integers(0, 3, (5, size))]
    every = np.full(1 << 10, np.uint64(2**64 - 1))
    made = [[] for _ in chars]
    for row, place, letter, kind in spelling.neighbours(chars, letters, every):
        for r, p, x in zip(row.tolist(), place.tolist(), letter.tolist(), strict=True):
            w = chars[r].tobytes().decode()
            made[r].append(w[:p] + ("" if kind == "delete" else "abc"[x]) + w[p + (kind != "insert") :])
    for w, own in zip(chars, made, strict=True):
        word = w.tobytes().decode()
        assert len(own) == len(set(own)) and set(own) == {x for x in around(word, "abc") if len(x) >= 6}
