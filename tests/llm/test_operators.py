"""Each operator against SQL, brute force, a round trip or held-out labels, and on odd rows."""

import hashlib
import io
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import duck, same

from factweave.llm import exact_dedup, html_text, language, line_dedup, links, media, mixing, near_dedup, packing, quality, substrings
from factweave.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked(sets, num, den):
    """Components of all pairs of sets that qualify."""
    groups, seen = Groups(sets), defaultdict(list)
    for i in sorted(sets):
        met = defaultdict(int)
        for x in sets[i]:
            for j in seen[x]:
                met[j] += 1
            seen[x].append(i)
        for j, n in met.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
    return groups


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, name):
    assert same(Q.QUERIES[name](spark, sf), duck(Q.SQL[name], sf))


def test_tree_merge_of_runs(spark):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('a b', 3), concat('t', id % 2500, repeat(' ', int(id % 7)))) AS text")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    want = defaultdict(list)
    for i in range(9_000):
        want["ababab" if i % 3 == 0 else f"t{i % 2500}"].append(((-9, i) if i % 3 == 0 else (-len(f"t{i % 2500}") - i % 7, i)))
    for t, own in want.items():
        for _, i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (min(own)[1], len(own), hashlib.sha256(t.encode()).hexdigest())
    rows = exact_dedup.digests(docs)
    plan = exact_dedup.tree_merge(rows, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_run") == 3 and plan.count("Sort [_run") == 3 and "Python" not in plan
    assert sorted(r.n for r in exact_dedup.tree_merge(rows, 8).collect()) == sorted(r.n for r in exact_dedup.tree_merge(rows, 512).collect()) == sorted(map(len, want.values()))


def test_near_groups_equal_brute_force(spark, sf, texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    groups = linked(sets, 80, 100)
    got = {r.doc_id: r for r in Q.QUERIES["op7_near_dedup"](spark, sf).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: groups.find(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_texts_of_one_id_are_linked_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, f"{a} tail"), (3, f"{b} tail"), (4, a), (5, "c d e f g"), (5, "c d e f g"), (6, f"{a} {b}"), (None, a), (None, a), (7, ""), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == [(0, 0, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False), (4, 1, False)] + [(5, 5, True)] * 2 + [(6, 6, True)] + [(7, 7, True)] * 2
    left = sorted((r.doc_id or 0, r.text) for r in near_dedup.near_dedup(docs).collect())
    assert left == [(0, a), (0, a), (1, a), (1, b), (5, "c d e f g"), (6, f"{a} {b}"), (7, ""), (7, "")]
    same = spark.createDataFrame([(1, a), (1, f"{a} tail"), (2, a)], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.near_dedup(same).collect()] == [1]


def test_substrings_equal_brute_force(spark, sf, texts):
    first = {}
    words = {i: WORD.findall(t) for i, t in texts}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r.doc_id: r for r in Q.QUERIES["op8_substring_dedup"](spark, sf).collect()}
    for i, w in words.items():
        alive = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                alive[k : k + 50] = [False] * 50
        kept = " ".join(x for x, a in zip(w, alive, strict=True) if a)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), alive.count(False), hashlib.sha256(kept.encode()).hexdigest())


def line_components(texts):
    """Components of all lines that are not empty: 8-character shingles, 0.8; shorter lines if equal."""
    sets = {}
    for i, t in texts:
        for n, x in enumerate(t.split("\n")):
            if x := " ".join(WORD.findall(lower(x))):
                sets[i, n] = frozenset(x[j : j + 8] for j in range(max(len(x) - 8, 0) + 1))
    return linked(sets, 8, 10)


def test_lines_equal_brute_force(spark, sf, texts):
    groups = line_components(texts)
    got = {r.doc_id: r.text for r in Q.QUERIES["op10_line_dedup"](spark, sf).collect()}
    for i, t in texts:
        assert got[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in groups.up or groups.find((i, n)) == (i, n))


@pytest.mark.parametrize("size", [80, 100, 118])
def test_lines_with_one_inner_edit_are_linked(spark, size):
    line = "".join(chr(97 + int(x)) for x in np.random.default_rng(size).integers(0, 26, size))
    docs = spark.createDataFrame([(1, line), (2, f"{line[: size // 2]}0{line[size // 2 + 1 :]}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: line, 2: ""}


def test_equal_short_lines_are_repeats(spark):
    docs = spark.createDataFrame([(1, "Les.\n\nx\ntwelve chars\nbcdefghijklmnop"), (2, "les. \n\n y\nTwelve  chars\nLes\nabcdefghijklmno")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: "Les.\n\nx\ntwelve chars\nbcdefghijklmnop", 2: "\n y\nLes\nabcdefghijklmno"}


def test_packing_round_trip(spark, sf, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(list)
    places = defaultdict(list)
    for r in Q.QUERIES["op3_packing"](spark, sf).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in texts:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert sorted(got[i]) == [(k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(places) <= 1.1 * total / 2048 + 1


@pytest.mark.parametrize("word", ["It's 'S don't <|endoftext|> <|ENDOFTEXT|> a\xa0b a\x1cb", "İstanbul ΣΑΣ é é ½ ² x²y ª \xad a\xadb ÷× x\x85y \x00z ß ẞ １２ ñ1a!b?c 中文字 🙂a", ""])
def test_ids_equal_the_tokenizer(word):
    ids = packing.Ids(packing.default_tokenizer())
    assert ids.text(word.encode()) == np.array(ids.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed, n, spread", [(1, 0, 1), (2, 1, 1), (3, 300, 1.2), (4, 20_000, 1.2), (5, 5_000, 0.3)])
def test_plan_places_each_piece_once(seed, n, spread):
    lengths = np.clip(np.random.default_rng(seed).lognormal(5.5, spread, n), 1, 2048).astype(int)
    counts = np.bincount(lengths, minlength=2049)
    fill, seen = defaultdict(list), np.zeros(2049, int)
    for length, a, b, first, each, offset in sorted(packing.plan(counts), key=lambda r: r[:2]):
        assert a == seen[length]
        seen[length] = b
        for k in range((b - a) // each):
            fill[first + k].append((offset, each * length))
    assert (seen == counts).all()
    for own in fill.values():
        own.sort()
        assert all(o == sum(x for _, x in own[:k]) for k, (o, _) in enumerate(own)) and sum(x for _, x in own) <= 2048
    assert len(fill) <= 1.05 * lengths.sum() / 2048 + 2


def test_language_on_held_out(spark, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in Q.QUERIES["op1_language_id"](spark, sf).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in got]) > 0.97


def letters(text):
    return language.symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]


def kneser_ney(text, size, order):
    """P(symbol | context) of interpolated Kneser-Ney, by counting tuples; contexts as long as the text has them."""
    seq = [0] * (order - 1) + list(text)
    count = {order: defaultdict(int)}
    for i in range(order - 1, len(seq)):
        count[order][tuple(seq[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        count[k] = defaultdict(int)
        for g in count[k + 1]:
            count[k][g[1:]] += 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        once, twice = (sum(n == x for n in count[k].values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        own = {g: n for g, n in count[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * p(gram[1:])

    return p


def test_model_equals_kneser_ney_by_counting():
    texts = {"a": "the cat sat on the mat and the rat sat", "b": "der hund und die katze und der rabe"}
    model = language.Model({k: [letters(t)] for k, t in texts.items()}, order=3)
    size = len(model.common) + 2
    for j, t in enumerate(texts.values()):
        p = kneser_ney(model.ids(letters(t)).tolist(), size, 3)
        probe = [0, 0, *model.ids(letters("the rat und zzz katze")).tolist()]
        grams = [tuple(probe[i : i + 3]) for i in range(len(probe) - 2)]
        keys = np.array([(a << 32) | (b << 16) | c for a, b, c in grams], np.uint64)
        assert np.allclose(np.exp(model._known(keys, 3, j)), [p(g) for g in grams], rtol=1e-4)
    for j in range(2):
        for context in ([0], [1, 2], [3, 1]):
            keys = np.array([sum(c << 16 * (t + 1) for t, c in enumerate(reversed(context))) + x for x in range(size)], np.uint64)
            assert np.isclose(np.exp(model._known(keys, len(context) + 1, j)).sum(), 1, atol=1e-4)


def test_large_scripts_and_long_texts(spark):
    rng = np.random.default_rng(5)
    words = {"zh": [chr(c) for c in rng.integers(0x4E00, 0x9000, 900)], "zh2": [chr(c) for c in rng.integers(0x4E00, 0x9000, 900)], "ko": [chr(c) for c in rng.integers(0xAC00, 0xD700, 900)]}
    rows = [(100 * n + i, "".join(rng.choice(w, 60)), k) for n, (k, w) in enumerate(words.items()) for i in range(60)]
    docs = spark.createDataFrame([(i, t, k if i % 100 < 40 else None) for i, t, k in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_best for r in language.identify(docs, language.fit(docs)).collect()}
    assert np.mean([got[i] == k for i, _, k in rows if i % 100 >= 40]) > 0.95
    model = language.Model({"a": [letters("one two three")], "b": [letters("eins zwei drei")]})
    text = ("one two, drei! " * 5_000 + "  ... " * 9_000 + "zwei" * 7).encode()
    data = np.frombuffer(text, np.uint8)
    whole = language.symbols(data, np.array([0, len(data)]))[0]
    parts, size, some = model.long_entropies(data, 4_099)
    assert size == len(whole) and some and np.allclose(parts, model.entropies(whole, np.array([0, len(whole)]))[0], atol=1e-5)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in Q.QUERIES["op4_quality"](spark, sf).collect() if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_attention_equals_a_loop_over_passages():
    texts = ["one two three " * 60, "", "A, b! " * 500, "x"]
    raw = [t.encode() for t in texts]
    x, after = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    model = quality.GatedAttention(seed=3)
    got, p = model.scores(x, after), model.p
    for d in range(len(texts)):
        hs, weights = [], []
        for row in x[after[d] : after[d + 1]]:
            h = np.tanh(np.clip((row - model.mean) / model.scale, -8, 8) @ p["e"] + p["eb"])
            weights.append(np.exp(sum(p["w"][k] * np.tanh(h @ p["v"][:, k]) / (1 + np.exp(-(h @ p["u"][:, k]))) for k in range(len(p["w"])))))
            hs.append(h)
        z = sum(w * h for w, h in zip(weights, hs, strict=True)) / sum(weights)
        assert np.isclose(got[d], 1 / (1 + np.exp(-(z @ p["c"] + p["cb"]))))
        one, own = quality.passages(np.frombuffer(raw[d], np.uint8), np.array([0, len(raw[d])]))
        assert len(one) == max(1, -(-len(texts[d].split()) // 64)) and np.allclose(one, x[after[d] : after[d + 1]], atol=1e-6)


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 200) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    seen = []
    monkeypatch.setattr(quality.GatedAttention, "fit", lambda self, x, after, y: seen.append(len(y)))
    for most, want in ((64 << 20, 40), (5_500, 5), (10, 1)):
        monkeypatch.setattr(quality, "MOST_BYTES", most)
        quality.fit(docs, labels)
        assert seen.pop() == want


def test_media_round_trip(spark, sf, texts):
    got = {r.doc_id: r for r in Q.QUERIES["op5_media_columns"](spark, sf).collect()}
    for i, t in texts:
        raw = t.encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        stored = b"P5\n24 %d\n255\n" % (len(full) // 24) + full
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    for i, t in texts[:12]:
        raw = t.encode()
        image = np.frombuffer(raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw)), np.uint8).reshape(-1, 24)
        tile = np.load(io.BytesIO(got[i].tile))
        small = area_means(image, 8, 9)
        assert (tile[:, :, 0] == area_means(image, 32, 32)).all()
        assert got[i].feature == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex() + f":{zlib.crc32(got[i].tile):08x}"


def area_means(image, high, wide):
    """Means over equal areas by adding up every sample's share, one sample after the other."""
    out = np.zeros((high, wide))
    share = [[(k, max(0.0, min((k + 1) * n / c, p + 1) - max(k * n / c, p))) for k in range(c) if min((k + 1) * n / c, p + 1) - max(k * n / c, p) > 1e-12] for n, c in ((image.shape[0], high), (image.shape[1], wide)) for p in range(n)]
    down, across = share[: image.shape[0]], share[image.shape[0] :]
    for y, ys in enumerate(down):
        for x, xs in enumerate(across):
            for a, h in ys:
                for b, w in xs:
                    out[a, b] += h * w * image[y, x]
    return np.rint(np.round(out * high * wide / image.size, 9)).astype(np.uint8)


def test_broken_media_get_errors(spark):
    bad = [b"P5 0 5 255\n", b"P4 0 0\n", b"P5 99999999999 99999999999 255\n", b"P3 1 1 255 99999999999999999999 1 1", b"P2 70000 70000 255 1", b"BM" + bytes(10), b"BM" + bytes(100), b"P5 3 3 0\n" + bytes(9), b"P6 2 2 255\nabc"]
    rows = spark.createDataFrame([(i, x, "o") for i, x in enumerate(bad)], "id int, media binary, tile string")
    got = media.media_columns(rows).collect()
    assert len(got) == len(bad) and all(r.error and r.tile is None and r.samples is None and r.media_bytes for r in got)
    assert media.media_columns(rows.limit(0)).isEmpty()
    large = np.random.default_rng(2).integers(0, 256, (30_000, 150, 1)).astype(np.uint8)
    total = np.zeros((30_001, 151, 1))
    np.cumsum(np.cumsum(large, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    assert (media.area_resize(large, 8, 9) == np.rint(media._bands(media._bands(total, 8).swapaxes(0, 1), 9).swapaxes(0, 1) * 72 / large.size).astype(np.uint8)).all()


def test_media_formats(spark):
    grey = np.arange(24, dtype=np.uint8).reshape(4, 6, 1) * 10
    bmp = b"BM" + (54 + 4 * 20).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (6).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    bmp += b"".join(np.repeat(row, 3, axis=1).tobytes() + b"\0\0" for row in grey[::-1])
    plain = b"P2\n# c\n6 4\n255\n" + b" ".join(str(x).encode() for x in grey.ravel())
    images = [b"P5 6 4 255\n" + grey.tobytes(), bmp, plain, b"P4\n9 1\n\x80\x00", b"P1\n2 1\n1 0", b"P6\n1 1\n65535\n" + b"\xff\xff" * 3, b"P5 9 9 255\n", b"", None, b"nonsense"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(images)], "id int, media binary")
    got = {r.id: r for r in media.media_columns(rows).collect()}
    assert (media.decode(images[0]) == grey).all() and (media.decode(images[2]) == grey).all() and (media.decode(bmp) == np.repeat(grey, 3, axis=2)).all()
    assert media.decode(images[3]).ravel().tolist() == [0] + [255] * 8 and media.decode(images[4]).ravel().tolist() == [0, 255]
    assert got[0].dhash == got[1].dhash == got[2].dhash and got[5].channels == 3
    assert all(got[i].error and got[i].tile is None for i in (6, 7, 8, 9)) and not got[0].error


def test_bitmap_kinds():
    def bmp(depth, packed, body, extra=b"", wide=2, high=2):
        head = struct.pack("<IiiHHIIiiII", 40, wide, high, 1, depth, packed, 0, 0, 0, 0, 0)
        return b"BM" + struct.pack("<III", 0, 0, 54 + len(extra)) + head + extra + body

    table = b"".join(bytes([3 * i, 2 * i, i, 0]) for i in range(16))
    cells = lambda image: image[:, :, 0].tolist()
    assert cells(media.decode(bmp(1, 0, b"\x40\0\0\0\x80\0\0\0", table[:8]))) == [[1, 0], [0, 1]]
    assert cells(media.decode(bmp(4, 0, b"\x12\0\0\0\x34\0\0\0", table))) == [[3, 4], [1, 2]]
    assert cells(media.decode(bmp(8, 1, b"\2\5\0\0\1\7\1\6\0\1", table))) == [[7, 6], [5, 5]]
    assert cells(media.decode(bmp(8, 1, b"\0\3\1\2\3\0\0\0\0\2\2\0\1\4\0\1", table, wide=3))) == [[0, 0, 4], [1, 2, 3]]
    assert cells(media.decode(bmp(4, 2, b"\2\x12\0\0\2\x34\0\1", table))) == [[3, 4], [1, 2]]
    assert media.decode(bmp(16, 0, b"\0\x7c\xe0\3\x1f\0\xff\x7f")).tolist() == [[[0, 0, 255], [255] * 3], [[255, 0, 0], [0, 255, 0]]]
    assert media.decode(bmp(16, 3, b"\0\xf8\xe0\7\x1f\0\0\0", struct.pack("<3I", 0xF800, 0x7E0, 0x1F))).tolist() == [[[0, 0, 255], [0] * 3], [[255, 0, 0], [0, 255, 0]]]
    assert media.decode(bmp(32, 3, b"\1\2\3\0" * 4, struct.pack("<3I", 255, 255 << 8, 255 << 16)))[0, 0].tolist() == [1, 2, 3]


def test_area_resize_keeps_means():
    image = np.random.default_rng(1).integers(0, 256, (37, 53, 1)).astype(np.uint8)
    assert abs(float(media.area_resize(image, 5, 7).mean()) - float(image.mean())) < 1
    assert (media.area_resize(image, 37, 53) == image).all()


def test_pages(spark, sf):
    page = """<html><body><header>Top</header><nav><a href=/>x</a></nav><div id="content"><div class=post><h2>T</h2><p>Hello &amp; welcome, a paragraph,
      with commas, and more text.<p>Second one with <a href=x>a link</a>, and more text to fill it up.</div><div class="comments"><p>A comment, long enough, with commas, and more.</p></div></div><aside>side</aside><footer>foot</footer></body>"""
    assert html_text.main_text(page) == "T\n\nHello & welcome, a paragraph, with commas, and more text.\n\nSecond one with a link, and more text to fill it up."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>var a = '<p>x</p>'</script>", "plain  text", "<article><p>a</article>")] == ["", "", "", "", "plain text", "a"]
    got = Q.QUERIES["op9_html_text"](spark, sf).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) and "track(" not in r.text and "&middot;" not in r.text for r in got)


A = "The first paragraph of the story, with commas, has enough words to count as text. It goes on for a while."
B = "The second one, too, is long enough, and it says something more about the matter at hand than the first."
GOLD = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><article><h1>Head</h1><p>{A}</p><p>{B}</p></article><footer>(c) us</footer></body></html>", ["Head", A, B]),
    (f"<div id=header><a href=/>Site</a></div><table><tr><td class=menu><a href=1>One</a><a href=2>Two</a><td><h1>Head</h1><p>{A}<p>{B}</table>", ["Head", A, B]),
    (f"<main><h2>Head</h2><p>{A}</p><div class='ad banner'><p>Buy now, cheap, while it lasts, and tell your friends about it.</p></div><p>{B}</p></main>", ["Head", A, B]),
    (f"<div class=post><p>{A}</p><blockquote><p>{B}</p></blockquote><ul><li>First point of the list</li><li>Second point of the list</li></ul></div><div id=comments><p>{A}</p></div>", [A, B, "First point of the list", "Second point of the list"]),
    (f"<div class=cookie-notice><p>We use cookies, as everyone does, to make the site better for all.</p></div><article><p>{A}</p><pre>x = 1,  y = 2</pre><p>{B}</p></article>", [A, "x = 1, y = 2", B]),
    (f"<article><p>{A}</p><form><label>Mail</label><input><button>Go</button></form><script>document.write('<p>{B}</p>')</script><p>{B}</p><aside><p>{A}</p></aside></article>", [A, B]),
    (f"<body><div><div><section><p>Caf&eacute; &amp; bar &#8212; {A}</p><p>{B}<br>next&nbsp;line</p></section></div></div><div class=related><a href=a>{A}</a></div></body>", [f"Café & bar — {A}", f"{B} next line"]),
    (f"<article><header><h1>Head</h1></header><p>{A}</p><figure><img src=x><figcaption>A caption, short.</figcaption></figure><p>{B}</p><footer>Tags: <a href=t>t</a></footer></article>", ["Head", A, "A caption, short.", B]),
    (f"<p>{A}</p>", [A]),
    ("<nav><a href=/>Home</a></nav><footer>Nothing but furniture here, alas, and no text.</footer>", []),
]


@pytest.mark.parametrize("page, want", GOLD)
def test_gold_pages(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def test_deep_and_broken_pages_take_linear_time(spark):
    import time

    deep = "<div class=promo>" * 60_000 + f"<p>{A}</p>" + "</span></b>" * 60_000
    began = time.time()
    assert html_text.main_text(deep) == A
    assert html_text.main_text(f"<p>{A}" + "<b><i>" * 30_000 + "<div>x</div>" * 30_000).startswith(A)
    assert time.time() - began < 30
    rows = spark.createDataFrame([(1, "u", deep, "t", 5), (2, None, None, None, None), (2, None, None, None, None), (3, "v", "", "x", 1)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(rows).collect())
    assert got == [(1, A, len(A)), (2, "", 0), (2, "", 0), (3, "", 0)] and html_text.extract(rows.limit(0)).isEmpty()


@pytest.mark.parametrize("names", ["class='layout has-sidebar'", "id='page' class='no-ads'", "class='post comments-open'"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_wrappers_named_like_furniture_stay(names, tag):
    own = "A first paragraph, with commas, and enough text to count. " * 3
    page = f"<body><div {names}><{tag}><p>{own}</p><p>{own}</p></{tag}><div class=sidebar><p>Side text, some more of it, and more.</p></div></div></body>"
    assert html_text.main_text(page) == "\n\n".join([own.strip()] * 2)
    talk = f"<article><p>{own}</p></article><div class=comments><p>{own * 5}</p></div><section class=related><article><p>{own * 4}</p></article></section>"
    assert html_text.main_text(f"<div {names}>{talk}</div>") == html_text.main_text(talk) == own.strip()


def test_big_blocks_are_split_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = {i: np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for i in range(60)}
    rows = spark.createDataFrame([(i, 0, len(s), ",".join(map(str, s))) for i, s in sets.items()], "id long, block long, weight long, text string")
    parse = lambda t: (lambda xs: (np.concatenate(xs), np.concatenate([[0], np.cumsum([len(x) for x in xs])])))([np.array(x.split(","), np.uint64) for x in t.to_pylist()])
    add = lambda f: rows.select("id", "text").join(f, "id")
    found = links.verified_links(rows.drop("text"), add, parse, 8, 10, task=600)
    got = {r.node: r.component for r in links.components(found).collect()}
    want = linked({i: frozenset(s.tolist()) for i, s in sets.items()}, 8, 10)
    assert {i: got.get(i, i) for i in sets} == {i: want.find(i) for i in sets}


def test_long_texts(spark):
    """A text of 20 MB goes through the operators that read whole texts."""
    rng = np.random.default_rng(9)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(5_000)])
    lines = [" ".join(words[rng.integers(0, 5_000, 12)]) for _ in range(240_000)]
    long = "\n".join(lines)
    docs = spark.createDataFrame([(1, long, "en"), (2, "\n".join(lines[:50]), "en"), (3, "short text of few words", "en")], "doc_id long, text string, lang string")
    assert len(long) > 20_000_000
    assert {r.doc_id: r.lang_best for r in language.identify(docs, language.fit(docs)).collect()} == {1: "en", 2: "en", 3: "en"}
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, 4).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 600, 3: 0}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 50, 3: 0}
    assert {r.doc_id: r.n for r in quality.score(docs, quality.GatedAttention()).selectExpr("doc_id", "int(score >= 0) AS n").collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.error for r in media.media_columns(docs, "text", encode=media.text_image).select("doc_id", "error").collect()} == {1: None, 2: None, 3: None}


def test_odd_rows(spark, odd, none):
    """Counts, nulls and repeats as the docstrings state them; empty tables give empty results."""
    n = odd.count()
    kept = exact_dedup.exact_dedup(odd).collect()
    assert len(kept) == n and {r.keep_id for r in kept if r.doc_id == 3} == {5} and {r.group_size for r in kept if r.doc_id in (3, 4, 5)} == {4}
    near = {r.doc_id: r for r in near_dedup.near_groups(odd, 4).collect() if r.doc_id}
    assert near[2].component_id == 1 and near[7].component_id == 6 and near[3].n_shingles == 0 and near[8].n_shingles == 1
    assert near_dedup.near_dedup(odd, 4).columns == odd.columns
    cut = {r.doc_id: r for r in substrings.remove_repeats(odd).collect() if r.doc_id}
    assert cut[7].n_removed == 30_000 and cut[6].n_removed == 0 and cut[3].n_words == 0 and cut[7].kept_text == "tail"
    lines = line_dedup.dedup_lines(odd)
    assert lines.count() == n and set(odd.columns) < set(lines.columns) and {r.text for r in lines.filter("doc_id = 2").collect()} == {""}
    assert {r.text for r in lines.filter("doc_id = 10").collect()} == {"x\n\n\ny"}
    model = language.fit(odd)
    assert {r.lang_best for r in language.identify(odd, model).filter("doc_id IN (3, 4, 5)").collect()} == {"und"}
    assert language.identify(odd, language.fit(none)).filter("lang_best <> 'und'").isEmpty()
    assert quality.score(odd, None).select("score").distinct().collect()[0][0] == 1.0 and quality.fit(none, spark.createDataFrame([], "doc_id long, quality int")) is None
    mixed = mixing.mix(odd, epochs=3.0)
    assert mixed.filter("doc_id IS NULL").count() >= 0 and mixing.mix(odd, {"s0": 1.0}, epochs=40.0).filter("source <> 's0' OR source IS NULL").isEmpty()
    packed = packing.pack_documents(odd).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.piece == 0 for r in packed) == n
    shown = media.media_columns(odd, "text", encode=media.text_image).collect()
    assert len(shown) == n and {r.samples for r in shown if r.doc_id in (3, 4)} == {576}
    assert language.identify(none, model).isEmpty() and quality.score(none, quality.GatedAttention()).isEmpty()
    for empty in (exact_dedup.exact_dedup(none), near_dedup.near_groups(none), substrings.remove_repeats(none), line_dedup.dedup_lines(none), mixing.mix(none), packing.pack_documents(none)):
        assert empty.isEmpty()


def test_mix_reaches_its_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 10 < 7, 'a', 'b') AS source", "'t' AS text")
    got = {r.source: r.n for r in mixing.mix(docs, {"a": 1.0, "b": 3.0}).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert abs(got["a"] - 5_000) < 300 and abs(got["b"] - 15_000) < 500


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        if name != "packing":
            assert docs.columns == before.columns
        if name == "quality_filter":
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert np.mean([(i in left) == (q == 1) for i, q in label.items()]) > 0.9
        if name == "near_dedup":
            assert near_dedup.near_groups(docs).filter("NOT kept").isEmpty()
    assert docs.count() > 0 and docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
    pieces = lambda d: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert pieces(corpus_pipeline.run(spark, sf)) == pieces(docs)
