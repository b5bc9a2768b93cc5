"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, worker_cache

HASHED = 1 << 16  # weights per label
ORDERS = (1, 2, 3, 4)  # n-grams of ^word$; those with ^ or $ are its affixes
UNIT = 512  # words of a chain that are gone through in step; longer chains are joined exactly by their units' transfer matrices
SAMPLE_PER_LABEL = 200  # documents to learn from, per label, in expectation (4 times that at most)
SAMPLE_CHARS = 1600  # of each, from a hashed place
ROUNDS = 25
CACHED = 250_000  # words a worker remembers


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ^word$ one after another, and where each word starts."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.flatnonzero(codes == 2)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased words: (ids, word of each). Affixes and inner n-grams, and the word itself."""
    codes, starts = _codes([w.replace("\x02", " ").replace("\x03", " ") for w in words])
    owner = np.zeros(len(codes), np.int64)
    owner[starts] = 1
    owner = np.cumsum(owner) - 1
    ids, who = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        same = owner[:m] == owner[n - 1 :]
        ids.append((h[same] >> np.uint64(20)) & np.uint64(HASHED - 1))
        who.append(owner[:m][same])
    if len(words):  # lexicon: the whole word, from sums over its characters at their places
        place = np.arange(len(codes)) - starts[owner]
        mixed = (codes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
        mixed ^= mixed >> np.uint64(31)
        whole = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
        ids.append((whole >> np.uint64(17)) & np.uint64(HASHED - 1))
        who.append(np.arange(len(words)))
    return np.concatenate(ids).astype(np.int64), np.concatenate(who)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False, end: np.ndarray | None = None):
    """Posterior of each label at each position of many chains, in step over positions.

    emit: exp'd scores, one row per word; chain i is emit[starts[i] : starts[i] + lengths[i]]. move and begin:
    exp'd transition and first scores; begin, and end (what follows the last word, else 1), may have a row per chain. Messages are normalised at each step. With pairs
    also the expected transitions, the expected first labels and the log partition sum.
    """
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    most = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(most), side="left") if most else []
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    log_z = 0.0
    a = begin[order] if begin.ndim > 1 else np.broadcast_to(begin, (len(first), len(begin)))
    for t in range(most):
        n = active[t]
        at = first[:n] + t
        a = (a[:n] if t == 0 else a[:n] @ move) * emit[at]
        z = a.sum(1, keepdims=True)
        a = a / z
        ahead[at] = a
        if pairs:
            log_z += float(np.log(z).sum())
    b = np.ones((len(first), emit.shape[1]), emit.dtype) if end is None else end[order].astype(emit.dtype)
    for t in range(most - 1, -1, -1):
        n = active[t]
        m = active[t + 1] if t + 1 < most else 0
        if m:
            c = (b[:m] * emit[first[:m] + t + 1]) @ move.T
            b[:m] = c / c.sum(1, keepdims=True)
        back[first[:n] + t] = b[:n]
    post = ahead * back
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post
    inner = np.ones(len(emit), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    joint = ahead[at][:, :, None] * move[None] * (emit[at + 1] * back[at + 1])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return post, joint.sum(0), post[starts].sum(0), log_z


def posteriors(emit: np.ndarray, counts: np.ndarray, move: np.ndarray, begin: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """Forward-backward over whole texts, one chain each; counts: words of each text.

    Chains of more than `unit` words are cut into units, so that one very long text does not make the others wait: each unit's transfer
    matrix is built in step with the others', the messages at the cuts follow from those, and each unit runs with
    the messages that enter it. The result is that of the uncut chain.
    """
    ends = np.cumsum(counts)
    pieces = -(-counts // unit)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (ends - counts)[text] + nth * unit
    lengths = np.minimum(unit, ends[text] - starts)
    n = emit.shape[1]
    first, last = np.broadcast_to(begin, (len(text), n)).copy(), np.ones((len(text), n), emit.dtype)
    long_ = np.flatnonzero(pieces[text] > 1)
    if len(long_):
        at, size = starts[long_], lengths[long_]
        over = emit[at][:, :, None] * np.eye(n, dtype=emit.dtype)
        for t in range(1, int(size.max())):
            on = np.flatnonzero(size > t)
            step = (over[on] @ move) * emit[at[on] + t][:, None, :]
            over[on] = step / step.sum((1, 2), keepdims=True)
        for i in range(1, len(long_)):  # forward over the cuts
            u = long_[i]
            if nth[u]:
                a = (first[u - 1] @ over[i - 1]) @ move
                first[u] = a / a.sum()
        for i in range(len(long_) - 2, -1, -1):  # and back
            u = long_[i]
            if nth[u] + 1 < pieces[text[u]]:
                b = move @ (over[i + 1] @ last[u + 1])
                last[u] = b / b.sum()
    return forward_backward(emit, starts, lengths, move, first, end=last)


@dataclass
class Crf:
    """Weights of the field; labels are in order of code points."""

    labels: list[str]
    weights: np.ndarray  # HASHED x labels
    move: np.ndarray
    begin: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of lower-cased words; words without a letter are neutral."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            ids, who = features(part)
            for k in range(len(self.labels)):
                out[i : i + len(part), k] = np.bincount(who, self.weights[ids, k], len(part))
        out[[not has_letter(w) for w in words]] = 0
        return out


def train(samples: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 5) -> Crf:
    """Fit the field by Adam on the exact conditional likelihood.

    samples: (text, label). Every word carries the label of its text. Half of the chains are
    code-switched, spliced from runs of two texts, so that transitions between labels are learned.
    """
    labels = sorted({b for _, b in samples}, key=str.encode)
    at, n = {b: i for i, b in enumerate(labels)}, len(labels)
    rng = np.random.default_rng(seed)
    runs = [(t.lower().split(), at[b]) for t, b in samples]
    runs = [r for r in runs if r[0]]
    chains = [(w, [k] * len(w)) for w, k in runs]
    if len(runs) > 1:
        for i, j in zip(rng.integers(len(runs), size=len(runs)), rng.integers(len(runs), size=len(runs)), strict=True):
            words, gold = [], []
            for w, k in (runs[i], runs[j], runs[i]):
                a = int(rng.integers(len(w)))
                part = w[a : a + int(rng.integers(2, 30))]
                words += part
                gold += [k] * len(part)
            chains.append((words, gold))
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws, _ in chains for w in ws], np.int64)
    gold = np.array([k for _, g in chains for k in g], np.int64)
    model = Crf(labels, np.zeros((HASHED, n), np.float32), np.ones((n, n), np.float32), np.ones(n, np.float32))
    if not len(word) or n == 1:
        return model
    lengths = np.array([len(w) for w, _ in chains])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    names = list(vocabulary)
    ids, who = features(names)
    letter = np.array([has_letter(w) for w in names])
    keep = letter[who]
    ids, who = ids[keep], who[keep]
    used, ids = np.unique(ids, return_inverse=True)
    onehot = np.eye(n)[gold]
    inner = np.ones(len(word), bool)
    inner[starts + lengths - 1] = False
    seen = np.flatnonzero(inner)
    goal_move = np.zeros((n, n))
    np.add.at(goal_move, (gold[seen], gold[seen + 1]), 1)
    goal_begin = onehot[starts].sum(0)
    w, mv, bg = np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, mv, bg)]
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(who, w[ids, k], len(names)) for k in range(n)], 1)
        emit = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0))[word]
        post, move, begin, _ = forward_backward(emit, starts, lengths, np.exp(mv), np.exp(bg), pairs=True)
        miss = onehot - post
        per = np.stack([np.bincount(word, miss[:, k], len(names)) for k in range(n)], 1)
        grad = np.stack([np.bincount(ids, per[who, k], len(used)) for k in range(n)], 1)
        for x, g, s, rate in ((w, grad - 0.1 * w, state[0], 0.15), (mv, goal_move - move - mv, state[1], 0.3), (bg, goal_begin - begin - bg, state[2], 0.3)):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.98 * s[1] + 0.02 * g * g
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.98**step)) + 1e-6)
    model.weights[used] = w
    model.move, model.begin = np.exp(np.clip(mv, -30, 30)).astype(np.float32), np.exp(np.clip(bg, -30, 30)).astype(np.float32)
    return model


def sample(df: DataFrame, held_out, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows to learn from: rows by a hash of doc_id, a window of each.

    Label frequencies are counted over all rows that may be learned from; each label's rows are then
    taken at the rate that gives per_label of them, 4 * per_label * labels at most in all. Every label is learned; the driver holds
    a row per label.
    """
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_label / r["count"]))])
    hashed = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 30))
    part = F.substring(F.col("text"), (F.lit(1) + hashed(2) % F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int"), F.lit(chars))
    rows = rows.where(hashed(1) < F.element_at(rate, F.col("lang")) * float(1 << 30)).select(hashed(3).alias("h"), part.alias("text"), "lang")
    return [(r["text"], r["lang"]) for r in sorted(rows.orderBy("h", "text").limit(4 * per_label * len(counts)).collect())]


class _Known(dict):
    """Word -> row of the table of emissions; unknown words queue for the next look-up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


def _emit_of(model: Crf, name: str):
    def look_up(texts: list[list[str]]):
        fresh = lambda: [_Known(), np.zeros((0, len(model.labels)), np.float32), np.zeros(0, bool)]
        held = worker_cache(f"emissions of {name}", fresh)
        if len(held[0]) > CACHED:
            held[:] = fresh()
        known, table, letter = held
        ids = np.fromiter((known[w] for ws in texts for w in ws), np.int64, sum(map(len, texts)))
        if known.new:
            low = [w.lower() for w in known.new]
            score = model.emissions(low)
            table = np.concatenate([table, np.exp(np.clip(score - score.max(1, keepdims=True, initial=-1e30), -30, 0))])
            letter = np.concatenate([letter, [has_letter(w) for w in low]])
            known.new = []
            held[:] = known, table, letter
        return ids, table, letter

    return look_up


def identify(df: DataFrame, model: Crf) -> DataFrame:
    """Label the words of each whole text and sum up per document; adds lang_pred and score.

    df: any columns, among them text. lang_pred is the label with the greatest sum of posteriors over words
    with letters, score its share of that sum (0 to 1), n_words the words with letters, and n_switches how often
    neighbours among those have different best labels. Null text, text without letters, or a model without labels
    gives `und` and 0. Ties go to the first label; equal texts get equal answers, whatever their doc_id, which may be null; an empty table gives an empty result. Columns lang_pred, score, n_words, n_switches of the input are replaced.
    """
    spark = prepare(df.sparkSession).sparkContext
    held = spark.broadcast(model)
    name = f"{id(held)}-{held._jbroadcast.id() if held._jbroadcast is not None else 0}"
    out = ["lang_pred", "score", "n_words", "n_switches"]
    df = df.drop(*out)
    at = df.columns.index("text")

    def judge(texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        model = held.value
        words = [t.split() if t else [] for t in texts]
        none = ("und", 0.0, 0, 0)
        if not model.labels:
            return [none] * len(texts)
        ids, table, letter = _emit_of(model, name)(words)
        counts = np.array([len(w) for w in words], np.int64)
        if len(ids):
            post = posteriors(table[ids], counts, model.move, model.begin)
            real = letter[ids]
            best = post.argmax(1)
            owner = np.repeat(np.arange(len(texts)), counts)
            sums = np.stack([np.bincount(owner[real], post[real, k], len(texts)) for k in range(len(model.labels))], 1)
            many = np.bincount(owner[real], minlength=len(texts))
            o, b = owner[real], best[real]
            switches = np.bincount(o[1:][(o[1:] == o[:-1]) & (b[1:] != b[:-1])], minlength=len(texts))
        rows = []
        for i in range(len(texts)):
            if not len(ids) or not many[i]:
                rows.append(none)
            else:
                k = int(sums[i].argmax())
                rows.append((model.labels[k], float(min(1.0, sums[i, k] / many[i])), int(many[i]), int(switches[i])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 2_000_000):
                    size += len(texts[j] or "")
                    j += 1
                lang, score, many, switches = zip(*judge(texts[i:j]), strict=True)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(lang), pa.array(score), pa.array(many, pa.int64()), pa.array(switches, pa.int64())], [*b.schema.names, *out])
                i = j

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType())])
    return df.mapInArrow(run, schema)


def word_labels(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """Each word of one text with its label and posterior."""
    words = text.split()
    if not words:
        return []
    score = model.emissions([w.lower() for w in words])
    emit = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0))
    post = posteriors(emit, np.array([len(words)]), model.move, model.begin)
    return [(w, model.labels[k], float(p[k])) for w, p, k in zip(words, post, post.argmax(1), strict=True)]


def held_out(doc_id="doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
