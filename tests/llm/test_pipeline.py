"""The whole pipeline against a plain single-threaded version of each stage, and odd tables through each stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_lines import brute as brute_lines
from volumetra.llm import langid, mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with this from have were which their would about into over", "fr": "les des une dans pour que qui est sur avec plus par cette sont mais"}


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(90):
        lang = ("en", "fr")[i % 2]
        words = WORDS[lang].split() + [f"{lang}{k}" for k in range(300)]
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 40))) for _ in range(rng.randint(1, 8))]
        rows.append([i, "\n".join(lines), lang if i % 3 else None, ["web", "books", None][i % 3], 0])
    run = "\n".join(rows[0][1].split("\n")[:1] + ["shared line one", "shared line two", "shared line three"])
    for i in (5, 9, 21):
        rows[i][1] += "\n" + run
    for i in (30, 31, 32):  # near copies
        rows[i + 30][1] = rows[i][1].replace("the", "teh", 1).replace("les", "lse", 1)
    rows += [[200, None, "en", "web", None], [201, "", "en", "web", 0], [202, "12 34 ...", None, "web", 9], [203, rows[3][1], "fr", "books", 1], [204, rows[3][1], "fr", "books", 1], [205, " ".join(["the of and that"] * 3000), "en", "web", 0]]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]


def mark(text, model):
    """Label and share by a chain of plain matrix products."""
    words = (text or "").split()
    letters = [langid.has_letter(w.lower()) for w in words]
    if not any(letters):
        return "und", 0.0
    score = model.emissions([w.lower() for w in words]).astype(float)
    e = np.exp(score - score.max(1, keepdims=True))
    ahead, back = [model.begin * e[0]], [np.ones(len(model.begin))]
    for x in e[1:]:
        a = (ahead[-1] @ model.move) * x
        ahead.append(a / a.sum())
    for x in e[:0:-1]:
        b = model.move @ (x * back[-1])
        back.append(b / b.sum())
    post = np.array(ahead) * np.array(back[::-1])
    post /= post.sum(1, keepdims=True)
    sums = post[letters].sum(0)
    return model.labels[int(sums.argmax())], float(sums.max() / sum(letters))


def near(rows):
    sets = []
    for _, t in rows:
        p = (t or "").lower().split()
        sets.append(frozenset(tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))) if p else frozenset())
    comp, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                    low = min(comp[i], comp[j])
                    changed |= comp[i] != comp[j]
                    comp[i] = comp[j] = low
    best = {}
    for c, r in zip(comp, rows, strict=True):
        best[c] = min(best.get(c, r), r)
    return sorted(best.values())


def chosen(spark, rows, seed=7):
    """Copies of each document: whole ones, then in the order of the hash each that still fits."""
    order = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    order = {r.doc_id: r.u for r in order.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 2).alias("u")).collect()}
    size = {i: len((t or "").split()) for i, (t, _) in rows.items()}
    names = sorted({s for _, s in rows.values()}, key=lambda s: (s is None, s or ""))
    held = [sum(size[i] for i, (_, s) in rows.items() if s == n) for n in names]
    total, open_, want = 1.5 * sum(held), set(range(len(names))), [0.0] * len(names)
    while True:
        each = total / sum((5, 2, 1)[k % 3] for k in open_)
        over = {k for k in open_ if (5, 2, 1)[k % 3] * each > 2 * held[k]}
        for k in over or open_:
            want[k] = 2.0 * held[k] if over else (5, 2, 1)[k % 3] * each
        if not over or over == open_:
            break
        total -= sum(want[k] for k in over)
        open_ -= over
    copies = {}
    for k, n in enumerate(names):
        flow = min(round(want[k]), 2 * held[k])
        whole = min(2, flow // held[k])
        gap, stopped = flow - whole * held[k], False
        for i in sorted((i for i, (_, s) in rows.items() if s == n), key=order.get):
            fits = gap > 0 and size[i] <= gap and not (stopped and not size[i]) or (flow - whole * held[k] > 0 and not size[i] and not stopped)
            copies[i] = whole + int(fits)
            stopped |= not fits
            gap -= size[i] if fits else 0
    return copies


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(langid.sample(docs, langid.held_out()))
    kept = {}
    for i, t, _, s, _ in rows:
        lang, share = mark(t, model)
        assert lang == "und" or abs(share - 0.5) > 1e-6
        if lang != "und" and share >= 0.5:
            kept[i] = (t, s)
    assert 85 < len(kept) < len(rows)
    gone = brute_lines([(i, t) for i, (t, _) in kept.items()])
    cut = {}
    for i, (t, s) in kept.items():
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]]
        if left:
            cut[i] = ("\n".join(left), s)
    assert {203, 204} - set(cut) == {203, 204}
    alone = {i: cut[i] for i, _ in near([(i, t) for i, (t, _) in sorted(cut.items())])}
    assert len(alone) < len(cut)
    copies = chosen(spark, alone)
    path, want, lengths = packing.default_tokenizer(), Counter(), []
    for i, n in copies.items():
        ids = np.frombuffer(packing._ids([alone[i][0] or ""], path, False)[0], "<u4").tolist() + [1]
        for _ in range(n):
            for k in range(0, len(ids), packing.LENGTH):
                want[i, k // packing.LENGTH, k, len(ids[k : k + packing.LENGTH])] += 1
                lengths.append(len(ids[k : k + packing.LENGTH]))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    free = []  # the textbook rule
    for n in sorted(lengths, reverse=True):
        able = [f for f in free if f >= n]
        if able:
            free.remove(min(able))
        free.append((min(able) if able else packing.LENGTH) - n)
    assert len({r.sequence_id for r in out}) == len(free)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= packing.LENGTH


CLASH = ["_row", "_hash", "_size", "_copies", "_again", "_rest", "_u", "_key", "score", "n_words", "lang_pred", "n_lines", "kept_text", "n_removed", "row", "line", "piece", "length", "sequence_id", "_b", "component", "a.b"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, "the of and that with this", "en", None, None), (1, None, None, None, None), (2, "", "en", "web", 0), (3, "les des une dans pour que", "fr", "web", 3), (3, "les des une dans pour que", "fr", "web", 3), (4, "the of and\nthe of and\n" * 3, "en", "web", 9), (5, "this from have " * 2000, "en", "books", 1)]
    df = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], SCHEMA + "".join(f", `{c}` int" for c in CLASH))
    out = stage(spark, df, "").collect()
    assert out
    if name != "best_fit_packing":
        assert stage(spark, df, "").columns == df.columns
        for r in out:
            assert [r[len(rows[0]) + k] for k in range(len(CLASH))] == list(range(len(CLASH)))
    assert stage(spark, df.limit(0), "").count() == 0


def test_mixing_rows_against_the_plain_rule(spark):
    rows = {i: (t, s) for i, t, _, s, _ in corpus()}
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in rows.items()], "doc_id long, text string, source string")
    assert {r.doc_id: r._copies for r in mixing.mix(df).collect()} == chosen(spark, rows)


def test_flow_against_enumeration():
    """Small networks: no routing of whole tokens moves more, or as much at less cost."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(60):
        sources, patterns = rng.randint(1, 3), rng.randint(1, 3)
        members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(patterns)]
        supply, quotas = [rng.randint(0, 2) for _ in range(patterns)], [rng.randint(0, 4) for _ in range(sources)]
        ways = []
        for p in range(patterns):
            ways.append([x for x in product(*[range(2 * supply[p] + 1) if s in members[p] else [0] for s in range(sources)]) if sum(x) <= 2 * supply[p]])
        best = (0, 0)
        for x in product(*ways):
            if all(sum(y[s] for y in x) <= quotas[s] for s in range(sources)):
                moved = sum(map(sum, x))
                cost = sum(n + max(0, n - supply[p]) for p, n in enumerate(map(sum, x)))
                best = max(best, (moved, -cost))
        flow = mixing.min_cost_flow(supply, members, quotas)
        moved = sum(v for f in flow for v in f.values())
        cost = sum(v * (k + 1) for f in flow for (_, k), v in f.items())
        assert (moved, -cost) == best
        for p, f in enumerate(flow):
            assert all(s in members[p] for s, _ in f) and all(sum(v for (_, c), v in f.items() if c == k) <= supply[p] for k in range(2))


def test_overlapping_sources_reach_their_targets(spark):
    """Documents of two sources are routed to the one that is short."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(5, 15), [["a"], ["a", "b"], ["b", "c"], ["c"], None][i % 5]) for i in range(1000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    want, got = {}, Counter()
    for r in out:
        for s in r._for:
            got[s] += r._size
            assert s in (r.source or [None])
        want[min(r.source or [None], key=lambda x: (x is None, x or ""))] = r._target
    for s in ("a", "b", None):
        assert abs(got[s] - want[s]) < 0.08 * want[s] + 30
