"""Line dedup: the suffix array, its common prefixes and the deleted runs against brute force."""

import random

import pytest

from volumetra.llm import linededup

SCHEMA = "doc_id long, text string"


def brute(rows, min_lines=3, min_words=50):
    """Deleted lines by (doc_id, text): every window of any length that is a passage and starts earlier too."""
    order, seen, gone = sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)), set(), {}
    for d, t in order:
        parts, mine, new = t.split("\n"), set(), []
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                run = tuple(parts[i:j])
                if len(run) >= min_lines or sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        mine.update(range(i, j))
                    seen.add(run)
        gone[d, t] = mine
    return gone


def check(spark, rows, **how):
    gone = brute(rows, **how)
    for r in linededup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect():
        if r.text is None:
            assert (r.kept_text, r.n_lines, r.n_removed, r.n_runs) == (None, 0, 0, 0)
            continue
        mine = gone[r.doc_id, r.text]
        kept = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in mine)
        assert (r.kept_text, r.n_lines, r.n_removed, r.n_runs) == (kept, r.text.count("\n") + 1, len(mine), sum(i - 1 not in mine for i in mine)), r.doc_id


@pytest.mark.parametrize("seed", range(2))
def test_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice([1, 3, 24, 26, 51]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, ""), (103, rows[3][1]), (104, "\n".join([pool[0]] * 30)), (None, rows[5][1]), (105, rows[4][1] + "\n"), rows[7], rows[7]]
    check(spark, rows)
    if seed:
        check(spark, rows, min_lines=5, min_words=80)


def test_two_lines_with_fifty_words_go(spark):
    a, b = " ".join(["one"] * 26), " ".join(["two"] * 26)
    check(spark, [(1, f"x\n{a}\n{b}\ny"), (2, f"z\n{a}\n{b}\nw"), (3, f"{a}\nq\n{b}")])


def test_suffix_array_and_common_prefixes(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(12)] + [["a"] * 17, ["a"] * 17, ["z"]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "row long, text string")
    table = linededup.lines(df, "row").cache()
    ranks, levels = linededup.suffix_array(table)
    array = sorted(linededup.neighbours(ranks, levels).collect(), key=lambda r: r.at)
    ids = {(r.row, r.line): (r.a, r.b) for r in table.collect()}
    suffix = {(i, j): [ids[i, x] for x in range(j, len(t))] for i, t in enumerate(texts) for j in range(len(t))}
    mine = [suffix[r.row, r.line] for r in array]
    assert mine == sorted(mine)  # a text's end comes before any line
    many = {}
    for s in suffix.values():
        many[s[0]] = many.get(s[0], 0) + 1
    assert len(mine) == sum(many[s[0]] > 1 for s in suffix.values())
    for x, y, r in zip(mine, mine[1:], array[1:], strict=False):
        want = 0
        while want < min(len(x), len(y)) and x[want] == y[want]:
            want += 1
        assert r.lcp == want
    assert max(levels) == 16  # 17 equal lines, twice


def test_maximal_runs_longer_than_a_passage(spark):
    run = [f"line {i}" for i in range(37)]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", "d", *run, "e"])), (3, "\n".join([*run[:20], "f", *run[20:]]))]
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_runs, got[2].kept_text) == (37, 1, "c\nd\ne")
    assert (got[3].n_removed, got[3].n_runs, got[3].kept_text) == (37, 2, "f")


def test_null_text_beside_a_text_of_the_same_id(spark):
    check(spark, [(1, "a\nb\nc"), (2, None), (2, "a\nb\nc\nd"), (None, None), (3, "a\nb\nc")])


def test_very_long_text(spark):
    lines = [f"row {i % 16_000}" for i in range(32_000)]
    r = linededup.dedup(spark.createDataFrame([(1, "\n".join(lines)), (2, "x")], SCHEMA)).where("doc_id = 1").first()
    assert (r.n_lines, r.n_removed, r.n_runs) == (32_000, 16_000, 1)


def test_clashing_names_and_empty_tables(spark):
    rows = [(i, "a\nb\nc\n" + "xyz"[i % 3], *[i] * 10) for i in range(6)]
    names = ["_row", "_gone", "_hash", "_key", "row", "line", "gone", "a", "b", "rank"]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    out = linededup.dedup(df)
    assert out.columns == [*df.columns, "kept_text", "n_lines", "n_removed", "n_runs"]
    assert {r.doc_id: (r._row, r._gone, r.rank, r.n_removed) for r in out.collect()} == {i: (i, i, i, 0 if i == 0 else 3 if i < 3 else 4) for i in range(6)}
    assert linededup.dedup(df.limit(0)).count() == 0
