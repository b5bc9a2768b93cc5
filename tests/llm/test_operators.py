"""Corpus operators against brute force, on small fixtures with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from volumetra.llm import bwt, chaining, langid, linededup, media, mixing, nearcopies, packing, sharding, simhash
from volumetra.llm.common import components, prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = [line(30), line(25), line(28), line(3)]
    texts = [None, "", " \n\t", "…!?", "One", "Of a TWO", line(4000), "th.\nHetible " * 60, "\n".join(passage), "\n".join(passage)]
    for i in range(30):
        rows = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            rows[1:1] = passage[: rng.randint(1, 4)]
        texts.append("\n".join(rows))
    texts += texts[10:14] + [t.replace("a", "b", 1) for t in texts[14:18]] + ["same text here"] * 20
    rows = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 5 == 4], len(t or ""), -1, -1, "x") for i, t in enumerate(texts)]
    return rows + [(500, "twice " * 50, "en", "s0", 1, 1, 1, "y")] * 2


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, docs, empty):
    samples = [("the of and that with this", "en"), ("les des une dans pour", "fr")] * 20
    model = langid.train(samples)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert {rows[i].lang_pred for i in (0, 1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in rows.values())
    words = [w[1] for w in langid.word_labels("the of and that les des une dans", model)]
    assert words == ["en"] * 4 + ["fr"] * 4
    assert langid.identify(empty, model).count() == 0 and langid.identify(docs, langid.train([])).where("lang_pred <> 'und'").count() == 0
    assert 0 < len(langid.sample(docs, langid.held_out())) <= 4 * langid.SAMPLE_PER_LABEL * 2


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, move, begin = rng.random((4, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = begin[path[0]] * math.prod(emit[t, k] for t, k in enumerate(path)) * math.prod(move[a, b] for a, b in zip(path, path[1:]))
        for t, k in enumerate(path):
            want[t, k] += p
    got = langid.forward_backward(emit, np.array([0]), np.array([4]), move, begin)
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    cuts = packing.pieces(docs, length=64)
    rows = packing.pack(cuts, 64).collect()
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t, *_ in corpus()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) for r in rows)
    assert sum(r.length for r in rows if r.doc_id != 500) == sum(len(b) // 4 for i, b in ids.items() if i != 500)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.sequences(packing.pack(cuts, 64)).count() == len(by)
    assert packing.pack(packing.pieces(empty, with_ids=False)).count() == 0


def test_best_fit_is_the_textbook_rule():
    rng = random.Random(5)
    for _ in range(40):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 300))]
        free = []
        for s in sorted(sizes, reverse=True):
            able = [f for f in free if f >= s]
            if able:
                free.remove(min(able))
                free.append(min(able) - s)
            else:
                free.append(40 - s)
        assert packing.best_fit(Counter(sizes), 40)[1] == len(free)


def test_media(spark, docs, empty):
    rows = media.read_back(media.store(docs)).collect()
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    for r in rows:
        b = texts[r.doc_id]
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(rows) == len(corpus()) and media.read_back(media.store(empty)).count() == 0
    with pytest.raises(media.Unsupported):
        media.parse(b"GIF89a")
    noisy = bytes(np.random.default_rng(0).integers(0, 256, 64 * 9000, dtype=np.uint8))
    files = media.thumbnails(media.encode_many([noisy]))[0]
    assert len(files) == 2 and b"".join(g.tobytes() for _, _, g in files) == noisy


def test_jpeg_with_ac_coefficients():
    """A hand-made grey file with AC codes and no restart markers: DC 5, then 5 + 3."""
    dc, ac = (bytes([0, 2, 1, *[0] * 13]), bytes([3, 2, 0])), (bytes([1, 1, 1, *[0] * 13]), bytes([0, 0x11, 0xF0]))
    # blocks: DC size 3 (code 00) bits 101; AC run 1 size 1 (code 10) bit 1; end (0); DC size 2 (01) bits 11; zero run (110); end (0)
    bits = "00" + "101" + "10" + "1" + "0" + "01" + "11" + "110" + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + seg(0xC4, b"\x00" + dc[0] + dc[1]) + seg(0xC4, b"\x10" + ac[0] + ac[1]) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((w, h, grey),) = media.thumbnails([data])[0]
    assert (w, h) == (16, 8) and grey.tolist() == [[133, 136]]


def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs, 5).collect()
    texts = {i: t or "" for i, t, *_ in corpus()}
    place = {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0


def test_cuts_are_minimax():
    rng = random.Random(2)
    for t in range(60):
        keys = sorted(rng.sample(range(1 << sharding.BITS), rng.choice([1, 4, 60, 800])))
        size = {k: rng.randint(16, 400) * (1000 if rng.random() < 0.01 else 1) for k in keys}
        shards = rng.choice([1, 2, 7, 40])

        def summary(depth, within):
            cells = {}
            for k in keys:
                if within is None or k >> (sharding.BITS - within[0]) in within[1]:
                    p = k >> (sharding.BITS - depth)
                    c = cells.get(p, (p, 0, k, k))
                    cells[p] = (p, c[1] + size[k], c[2], k)
            return list(cells.values())

        own, ends = sharding.plan_cuts(summary, shards)
        rest = [k for k in keys if k not in own]
        sums = Counter()
        for k in rest:
            sums[sum(e < k for e in ends)] += size[k]

        def shards_for(room):
            n, at = 1, 0
            for k in rest:
                n, at = (n + 1, size[k]) if at + size[k] > room else (n, at + size[k])
            return n

        if rest:
            most = max(sums.values())
            assert shards_for(most) <= shards - len(own)
            assert most == max(map(size.get, rest)) or shards_for(most - 1) > shards - len(own)


def removed_by_brute_force(texts):
    seen = Counter(b[p : p + 200] for b in texts for p in range(len(b) - 199))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeated_strings(spark, docs, empty):
    rows = corpus() + [(600 + i, "z" * n, None, None, 0, 0, 0, "") for i, n in enumerate((199, 200, 201, 700))] + [(700, "ab" * 400 + "c", None, None, 0, 0, 0, "")]
    want = sorted((r[0], *w) for r, w in zip(rows, removed_by_brute_force([(r[1] or "").encode() for r in rows]), strict=True))
    got = sorted(tuple(r) for r in bwt.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == want
    assert bwt.remove_repeats(empty).count() == 0


def test_merged_transforms():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (40, 8, 60, 3, 0)]
    got = bwt.repeated_starts(texts, 8, 1)
    seen = Counter(t[p : p + 8] for t in texts for p in range(len(t) - 7))
    assert [g.tolist() for g in got] == [[p for p in range(len(t) - 7) if seen[t[p : p + 8]] > 1] for t in texts]


def test_merging_gives_common_prefixes(monkeypatch):
    rng = np.random.default_rng(7)
    strings = [rng.integers(1, 3, n).tolist() for n in (30, 1, 17, 25, 9, 40)]
    shards = [bwt.Shard(np.array([x for t in part for x in [*t, 0]], np.uint16), 64) for part in (strings[:2], strings[2:3], strings[3:])]
    side, common = bwt.merge([x.transform for x in shards], 12)
    assert np.bincount(side).tolist() == [33, 18, 77]
    rows = sorted((t[i:], k) for k, t in enumerate(strings) for i in range(len(t) + 1))
    for (x, _), (y, _), c in zip(rows, rows[1:], common[1:].tolist(), strict=False):
        want = 0
        while want < min(len(x), len(y), 12) and x[want] == y[want]:
            want += 1
        assert c == want
    texts = [bytes(rng.integers(97, 100, 400, dtype=np.uint8)) for _ in range(6)]
    texts += [texts[0][50:300] + b"!", texts[1][9:350]]
    one = bwt.repeated_starts(texts, 40, 8)
    monkeypatch.setattr(bwt, "SHARD", 64)
    assert [x.tolist() for x in one] == [x.tolist() for x in bwt.repeated_starts(texts, 40, 8)]


def test_tasks_with_nothing_to_decide(spark):
    """Many partitions: some hold only runs that their task has decided."""
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(i, text if i % 2 else "") for i in range(12)]
    for parts in (1, 200):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: r.n_removed for r in bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
        assert got == {i: len(t) for i, t in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_texts_with_one_head(spark):
    rng = random.Random(12)
    head = "".join(rng.choice("abcdef ") for _ in range(170))
    tails = ["".join(rng.choice("ghijkl ") for _ in range(rng.randint(25, 60))) for _ in range(2500)]
    texts = [head + t for t in tails] + [head + t for t in tails[:40]] + [("x" * k + head + tails[k])[:260] for k in range(41, 60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = sorted((r[0], *w) for r, w in zip(rows, removed_by_brute_force([t.encode() for t in texts]), strict=True))
    for hot in (200, bwt.HOT):
        got = sorted(tuple(r) for r in bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot).collect())
        assert got == want


def test_simhash(spark, docs, empty):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def slow(t):
        w = (t or "").encode().translate(lower).split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    rows = corpus()
    prints = [slow(r[1]) for r in rows]
    comp = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[rows[j][0]] > comp[rows[i][0]]:
                    comp[rows[j][0]], changed = comp[rows[i][0]], True
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {r[0]: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_lose_none(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    for b in base[:30]:
        for _ in range(4):
            base.append(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    base = sorted({x - (1 << 64) if x >> 63 else x for x in base})
    links = simhash.links(spark.createDataFrame([(x, i) for i, x in enumerate(base)], "fp long, rep long"))
    comp = {r.node: r.component for r in components(links).collect()}
    for i, x in enumerate(base):
        for j, y in enumerate(base[:i]):
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                assert comp[i] == comp[j]


def test_dense_runs_are_probed(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 4)
    fp = np.array(sorted({(1 << a) | (1 << b) for a in range(8) for b in range(8)}), np.int64)
    assert (simhash._links(np.zeros(len(fp), np.int64), fp) == 0).all()


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        n = len((r.text or "").split())
        assert r._size == n and r._copies in (0, 1, 2) and len(r._for) == r._copies
        sizes[r.source] += n
        taken[r.source] += n * r._copies
        target[r.source] = r._target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and taken[s] <= target[s] + 1 and {r._source_size for r in rows if r.source == s} == {sizes[s]}
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r._copies) for r in again) == Counter((r.doc_id, r._copies) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], [], None][i % 5]) for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(out) == 500 and all(set(r._for) <= set(r.source or [None]) | ({None} if not r.source else set()) for r in out)


def test_flow_is_cheapest():
    flow = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [12, 8])
    assert sum(v for f in flow for v in f.values()) == 20 and all(k == 0 for f in flow for (_, k) in f)
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, 1996.6666666, 998.3333333])


def test_passages(spark, docs, empty):
    rng = random.Random(8)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = line(80)
    fuzzy = [w if i % 11 else "changed" for i, w in enumerate(shared)]
    texts = [line(40) + shared + line(30), line(20) + shared, line(50) + fuzzy + line(9), line(300), None, ""]
    texts += [texts[3]] * 2
    rows = chaining.passages(spark.createDataFrame([(i, t if t is None or isinstance(t, str) else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert set(by) == {1, 2, 6, 7} and by[1].ref_doc_id == 0 and (by[1].start, by[1].end) == (20, 100)
    assert by[2].start <= 52 and by[2].end >= 125 and 0.8 <= by[2].similarity < 1 and by[6].ref_doc_id == by[7].ref_doc_id == 3
    assert chaining.passages(empty).count() == 0 and chaining.passages(docs).count() >= 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90)}


def test_ids_by_word_are_those_of_the_whole_text():
    rng = random.Random(1)
    signs = "abZÉéßµªºÿŒİıſ'.,!?-_<|>12 \n\t\x00\x1c\xa0́​е中🙂\xadÀﬁ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["it's don't a<|endoftext|>b <|startoftext|>, x<|endoftext|>.", "a.'s b.' 'S We'RE! ẞ", "Foo foo, FOO... foo"]
    path = packing.default_tokenizer()
    assert packing._ids(texts, path, True) == packing._ids(texts, path, False)


@pytest.mark.parametrize("small", [2, 16])
def test_near_copies_are_those_of_jaccard(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        texts.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", None, "a b", "A b", "a"]
    sets = []
    for t in texts:
        p = (t or "").lower().split()
        sets.append({tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set())
    comp, changed = list(range(len(texts))), True
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert {r.row: r.component for r in nearcopies.groups(df).collect()} == dict(enumerate(comp))
    assert nearcopies.groups(df.where("false")).count() == 0


def test_pipeline_drops_near_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(230)]
    copy = [w if i not in (30, 120, 190) else "other" for i, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(base[:100]))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == {1, 3}


def test_mixing_goes_on_past_what_does_not_fit(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(50, 60), "a") for i in range(300)] + [(1000, "w " * 20000, "a")] + [(2000 + i, "w " * 20, "b") for i in range(3)]
    for seed in range(3):
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=0.3, most=1, seed=seed).where("source = 'a'").collect()
        gap = out[0]._target - sum(r._size * r._copies for r in out)
        left = [r._size for r in out if not r._copies]
        assert -1 <= gap and left and gap < min(left) + 1


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rows = [(None, "alone without an id of its own"), (None, "the same few words again here"), (4, "the same few words again here"), (5, "twice the row and its id"), (5, "twice the row and its id"), (5, "one id but another text")]
    out = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([rows[0], rows[2], rows[3], rows[5]])


def test_simhash_of_rows_without_ids(spark):
    rows = [(None, "alpha beta gamma delta"), (9, "alpha beta gamma delta"), (None, "only here"), (3, None), (None, "")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.fingerprint, set()).add((r.doc_id, r.component_id))
    assert sorted(map(sorted, (map(str, x) for x in by.values()))) == sorted(map(sorted, (map(str, x) for x in ({(None, 9), (9, 9)}, {(None, None)}, {(3, 3), (None, 3)}))))
