"""Language identification of words and documents by a linear-chain CRF.

States are the languages, observations the words.  A word's score for a
language is a learned linear function of its affixes, inner n-grams and the
word itself (the lexicon), hashed into a fixed table; transitions between the
languages of neighbouring words are learned too, from sequences that switch
between labelled texts.  Forward-backward gives each word's probabilities; a
document's language is that with the greatest sum of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as T

#: The bound of what the model is fitted on: whole texts of so many labelled rows of each language, and of so many languages, the most frequent; and the size of the hashed table.
SAMPLE_ROWS, MOST_LANGS, LOG2 = 200, 256, 16
#: Words of a chunk in forward-backward.
CHUNK = 32
UNKNOWN = "und"


def words_of(text: pa.Array) -> T.Words:
    """The words in lower case, with characters composed (NFC), alike in training and prediction."""
    return T.Words(pc.utf8_lower(pc.utf8_normalize(text.fill_null("") if text.null_count else text, form="NFC")), "letters", lower=False)


def features(w: T.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words at these places, and where each word's begin.

    n-grams of 1 to 4 bytes of ``^word$``; those that touch an end are its affixes; and the word as a whole.
    """
    size = (w.end - w.start)[at] + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    buf = np.empty(bounds[-1], np.uint8)
    buf[bounds[:-1]], buf[bounds[1:] - 1] = 94, 36
    inner = np.ones(len(buf), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    src = np.repeat(w.start[at] - bounds[:-1] - 1, size) + np.arange(len(buf))
    buf[inner] = w.data[src[inner]]
    owner = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(buf)) - np.repeat(bounds[:-1], size)
    left = np.repeat(size, size) - place
    v = T.byte_values(5)[buf]
    feats, owners = [w.hash[at] >> T.U(64 - LOG2)], [np.arange(len(at))]
    h = v.copy()
    for n in range(2, 5):
        if len(h) < 2:
            break
        h = h[:-1] * T.U(0x9FB21C651E98DF25) + v[n - 1 :]
        ok = left[: len(h)] >= n
        feats.append(T.mix(h[ok] + T.U(n)) >> T.U(64 - LOG2))
        owners.append(owner[: len(h)][ok])
    f, o = np.concatenate(feats).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return f[order], np.searchsorted(o[order], np.arange(len(at) + 1))


class Model:
    """langs, weights (2**LOG2 x L), trans (L x L)."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.weights, self.trans = langs, np.zeros((1 << LOG2, n), np.float32), np.zeros((n, n), np.float32)

    def scores(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's score for each language: a mean over its features, of which it has one at least."""
        return np.add.reduceat(self.weights[f], bounds[:-1], axis=0) / np.sqrt(np.diff(bounds))[:, None].astype(np.float32)

    def marginals(self, scores: np.ndarray, n: np.ndarray, forward: list | None = None) -> np.ndarray:
        """Forward-backward over sequences of n words whose scores follow one another; rows sum to 1.

        Sequences are worked in chunks, all at once: the product of a chunk's
        matrices carries messages over it, so the steps are those of a chunk and
        the number of chunks, not the words of the longest text.  forward: gets
        the probabilities given the words so far.
        """
        langs = scores.shape[1]
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
        trans = np.exp(self.trans - self.trans.max())
        parts = -(-n // CHUNK)
        owner = np.repeat(np.arange(len(n)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = (np.cumsum(n) - n)[owner] + number * CHUNK
        size = np.minimum(CHUNK, n[owner] - number * CHUNK)
        before, after = np.full((len(owner), langs), 1.0 / langs, np.float32), np.ones((len(owner), langs), np.float32)
        if len(parts) and parts.max() > 1:
            self._carry(e, trans, parts[owner], number, first, size, before, after)
        order = np.argsort(-size, kind="stable")
        size, first, a, b = size[order], first[order], before[order], after[order]
        most = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # chunks with a word at t
        out = np.empty((len(scores), langs), np.float32)
        for t in range(most):
            k = alive[t]
            i = first[:k] + t
            x = (a[:k] if t == 0 else a[:k] @ trans) * e[i]
            a[:k] = out[i] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
        if forward is not None:
            forward.append(out.copy())
        for t in range(most - 1, -1, -1):
            k = alive[t]
            i = first[:k] + t
            x = out[i] * b[:k]
            out[i] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
            y = (e[i] * b[:k]) @ trans.T
            b[:k] = y / np.maximum(y.max(axis=1, keepdims=True), 1e-30)
        return out

    def _carry(self, e, trans, parts, number, first, size, before, after) -> None:
        """Fills in what reaches each chunk of a longer sequence from before it, and from after it."""
        langs = len(trans)
        long = np.flatnonzero(parts > 1)
        order = long[np.argsort(-size[long], kind="stable")]
        sizes = -size[order]
        q = np.zeros((len(order), langs, langs), np.float32)
        q[:, range(langs), range(langs)] = e[first[order]]
        for t in range(1, CHUNK):
            k = np.searchsorted(sizes, -t - 1, side="right")
            x = (q[:k].reshape(-1, langs) @ trans).reshape(-1, langs, langs) * e[first[order[:k]] + t][:, None, :]
            q[:k] = x / np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-30)
        place = np.full(len(number), -1)
        place[order] = np.arange(len(order))
        by_number = long[np.argsort(number[long], kind="stable")]
        bounds = np.searchsorted(number[by_number], np.arange(number[by_number[-1]] + 2))
        for j in range(1, len(bounds) - 1):
            at = by_number[bounds[j] : bounds[j + 1]]
            x = np.einsum("ki,kij->kj", before[at - 1], q[place[at - 1]]) @ trans
            before[at] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
        for j in range(len(bounds) - 2, 0, -1):
            at = by_number[bounds[j] : bounds[j + 1]]
            x = np.einsum("kij,kj->ki", q[place[at]], after[at]) @ trans.T
            after[at - 1] = x / np.maximum(x.max(axis=1, keepdims=True), 1e-30)


def fit(rows: list[tuple[str, str]], seed: int = 7, length: int = 40, epochs: int = 3, rate: float = 0.3) -> Model:
    """Maximises the conditional likelihood of labelled sequences that switch languages, by AdaGrad."""
    langs = sorted({lang for _, lang in rows})
    m = Model(langs)
    if not langs:
        return m
    r = np.random.default_rng(seed)
    w = words_of(pa.array([t for t, _ in rows], pa.large_string()))
    if not len(w.start):
        return m
    _, where, known = np.unique(w.hash, return_index=True, return_inverse=True)
    f, bounds = features(w, where)  # of each distinct word once
    label = np.repeat([langs.index(lang) for _, lang in rows], w.n)
    # pieces of 5 to 30 words of one text, in random order: neighbours within a sequence often differ in language
    pieces, begin = [], 0
    while begin < len(label):
        same = int(np.searchsorted(w.first, begin, side="right"))
        stop = min(begin + int(r.integers(5, 31)), int(w.first[same]) if same < len(w.first) else len(label))
        pieces.append(np.arange(begin, stop))
        begin = stop
    n_langs = len(langs)
    gw, gt = np.full(m.weights.shape, 1e-6, np.float32), np.full(m.trans.shape, 1e-6, np.float32)
    for _ in range(epochs):
        r.shuffle(pieces)
        line = np.concatenate(pieces)
        for start in range(0, len(line), 64 * length):
            part = line[start : start + 64 * length]
            n = np.full(-(-len(part) // length), length)
            n[-1] = len(part) - length * (len(n) - 1)
            at = bounds[known[part]]
            size = bounds[known[part] + 1] - at
            b = np.concatenate([[0], np.cumsum(size)])
            ff = f[np.repeat(at - b[:-1], size) + np.arange(b[-1])]
            s = m.scores(ff, b)
            y = label[part]
            p = m.marginals(s, n, forward := [])
            g = -p
            g[np.arange(len(part)), y] += 1
            each = np.repeat(g / np.sqrt(size)[:, None], size, axis=0)
            for k in range(n_langs):
                d = np.bincount(ff, weights=each[:, k], minlength=1 << LOG2).astype(np.float32) / 64
                d -= 1e-5 * m.weights[:, k]
                gw[:, k] += d * d
                m.weights[:, k] += rate * d / np.sqrt(gw[:, k])
            # expected transitions: forward of the one, transition, and the rest of the other's marginal
            inside = np.ones(len(part), bool)
            inside[np.concatenate([[0], np.cumsum(n)[:-1]])] = False
            j = np.flatnonzero(inside)
            trans = np.exp(m.trans - m.trans.max())
            a = forward[0][j - 1]
            pair = a[:, :, None] * trans[None] * (p[j] / np.maximum(a @ trans, 1e-30))[:, None, :]
            d = np.zeros_like(m.trans)
            np.add.at(d, (y[j - 1], y[j]), 1)
            d = (d - pair.sum(axis=0)) / 64
            gt += d * d
            m.trans += rate * d / np.sqrt(gt)
    return m


def label_words(m: Model, text: pa.Array) -> tuple[T.Words, np.ndarray]:
    """The words of a batch and the probabilities of each word's languages."""
    w = words_of(text)
    if not len(w.start) or not m.langs:
        return w, np.zeros((len(w.start), len(m.langs)), np.float32)
    _, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
    parts = [m.scores(*features(w, where[i : i + 20_000])) for i in range(0, len(where), 20_000)]
    return w, m.marginals(np.concatenate(parts)[back], w.n)


def sample(docs: DataFrame, text: str, lang: str, key, rows: int) -> list[tuple[str, str]]:
    """At most so many labelled rows of each language, the least by a hash of key and text; rows that are equal in both count once.

    A histogram of the hashes (16 bins for each power of two) tells where to cut, so that
    only about so many rows of each language are ever sorted or sent.
    """
    h = F.shiftrightunsigned(F.xxhash64(key, text), 2)
    one = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("lang"), h.alias("h"), F.floor(F.log2(h + 1.0) * 16).cast("int").alias("grade"))
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in one.select("lang", "grade", "h").distinct().groupBy("lang", "grade").count().collect():
        counts.setdefault(r["lang"], []).append((r["grade"], r["count"]))
    most = sorted(counts, key=lambda name: (-sum(c for _, c in counts[name]), name))[:MOST_LANGS]
    cuts = {}
    for name in most:
        n = 0
        for g, c in sorted(counts[name]):
            n += c
            if n >= rows:
                break
        cuts.setdefault(g, []).append(name)
    wanted = F.lit(False)
    for g, names in cuts.items():
        wanted = wanted | (F.col("lang").isin(names) & (F.col("grade") <= g))
    taken: dict[str, list[tuple[int, str]]] = {}
    for r in one.where(wanted).dropDuplicates(["lang", "h"]).select("lang", "h", "t").collect():
        taken.setdefault(r["lang"], []).append((r["h"], r["t"]))
    return [(t, name) for name in sorted(taken) for _, t in sorted(taken[name])[:rows]]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and the columns in keep, for every row of docs.

    score is the mean probability of lang_pred over the document's words.  A
    null text, or one without a letter, is ``und`` with score 0; so is every
    text if the model has learned no language.
    """
    keep = keep or []
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(doc_id, *keep).schema)
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = b.column(b.num_columns - 1)
        w, p = label_words(m.value, t)
        letters = pc.match_substring_regex(t.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        total = np.zeros((len(w.n), max(len(m.value.langs), 1)))
        full = np.flatnonzero(w.n)
        if len(full) and m.value.langs:
            total[full] = np.add.reduceat(p.astype(np.float64), w.first[full], axis=0) / w.n[full][:, None]
        best = total.argmax(axis=1)
        known = letters & (w.n > 0) & bool(m.value.langs)
        name = [m.value.langs[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
        score = np.where(known, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(name, pa.string()), pa.array(score)], [doc_id, *keep, "lang_pred", "score"])

    return shared.arrow_map(docs.select(doc_id, *keep, F.col(text).alias("_text")), run, fields + ", lang_pred string, score double")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows that are not held out; a row without a doc_id is held out."""
    return fit(sample(docs.where(fold(doc_id) != 2), text, lang, F.col(doc_id), rows))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows outside the held-out fold."""
    docs = shared.documents(spark, sf_dir)
    out = identify(docs, trained(docs))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
