"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

A word's score for each language sums the weights of its features: the whole word (lexicon), its affixes and its
inner byte n-grams up to four (n-grams over the word with a mark at either end, so those at an end are the affixes),
hashed to ``SLOTS``. Transitions are learned too. Forward-backward gives each word's marginals, and a document's
scores are their means over its words with a letter. All words of a group of documents are scored by type, and all
documents of a group step through their words side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import trimmed
from .words import LOWER, mix, placed

SLOTS = 1 << 16
LONGEST = 4
#: Labelled documents of each language that are trained on, at most: those with the least hashes of their ids and texts.
SAMPLE = 300
EPOCHS, LANE_WORDS, LANES, RATE, RIDGE = 3, 64, 128, 0.2, 1e-5
#: Text bytes of a group of documents that step side by side.
GROUP = 5 << 20
UNKNOWN = "und"

_R = np.random.default_rng(77).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of words (bytes raw[starts:ends], hashes h) one after another, and the n+1 offsets of the words."""
    size = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(size)))
    total = int(first[-1])
    b = np.zeros(total + LONGEST, np.uint64)
    inner = np.arange(total - 2 * len(size)) + np.repeat(starts - (first[:-1] - 2 * np.arange(len(size))), size - 2)
    place = np.arange(total - 2 * len(size)) + np.repeat(2 * np.arange(len(size)) + 1, size - 2)
    b[place] = raw[inner]
    b[first[:-1]], b[first[1:] - 1] = 1, 2
    left = np.repeat(first[1:], size) - np.arange(total)
    slots = np.empty((total, LONGEST), np.int32)
    g = np.zeros(total, np.uint64)
    for n in range(LONGEST):
        g = g + b[n : n + total] * _R[n]
        slots[:, n] = (mix(g + np.uint64(n)) >> np.uint64(48)).astype(np.int32)
        slots[left <= n, n] = -1
    slots[first[:-1], 0] = (mix(h) >> np.uint64(48)).astype(np.int32)  # the start mark alone says nothing: the lexicon's place
    flat = slots.ravel()
    keep = flat >= 0
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[first * LONGEST]


class Chain:
    """Documents' words laid out step by step (longest document first), for forward-backward over all at once."""

    def __init__(self, at: np.ndarray):
        size = np.diff(at)
        self.rank = np.argsort(-size, kind="stable")
        size = size[self.rank]
        self.live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        self.first = np.concatenate(([0], np.cumsum(self.live)))
        doc = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        self.word = np.empty(len(doc), np.int64)
        self.word[self.first[step] + doc] = np.repeat(at[:-1][self.rank], size) + step
        self.doc = np.empty(len(doc), np.int64)
        self.doc[self.first[step] + doc] = self.rank[doc]

    def marginals(self, e: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals for scores ``e`` (step by step) and transition scores; and expected transitions, if asked for."""
        e = np.exp(e - e.max(1, keepdims=True)) + 1e-30
        m = np.exp(move - move.max())
        f, back = np.empty_like(e), np.ones_like(e)
        for t, n in enumerate(self.live):
            s = self.first[t]
            x = e[s : s + n] if t == 0 else (f[self.first[t - 1] : self.first[t - 1] + n] @ m) * e[s : s + n]
            f[s : s + n] = x / x.sum(1, keepdims=True)
        moved = np.zeros_like(m)
        for t in range(len(self.live) - 2, -1, -1):
            s, r, n = self.first[t], self.first[t + 1], self.live[t + 1]
            x = e[r : r + n] * back[r : r + n]
            if pairs:
                p = f[s : s + n, :, None] * m * x[:, None, :]
                moved += (p / p.sum((1, 2), keepdims=True)).sum(0)
            x = x @ m.T
            back[s : s + n] = x / x.sum(1, keepdims=True)
        f *= back
        return f / f.sum(1, keepdims=True), moved


class Model:
    def __init__(self, languages: list[str]):
        self.languages, k = languages, len(languages)
        self.weights, self.move = np.zeros((SLOTS, k), np.float32), np.eye(k) * 2.0

    def scores(self, raw, starts, ends, h) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Scores of the distinct words, each word's place among them, and the distinct words' features."""
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        out, feats = np.empty((len(at), len(self.languages)), np.float32), []
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            slots, off = word_features(raw, starts[part], ends[part], h[part])
            out[i : i + 20_000] = np.add.reduceat(self.weights[slots], off[:-1], axis=0)
            feats.append((slots, np.diff(off)))
        return out, back, (feats, at)

    def train(self, texts: list[str], langs: list[str]) -> Model:
        """Adagrad on the log-likelihood of sequences pieced together from runs of several documents' words."""
        if len(self.languages) < 2 or not texts:
            return self
        rng = np.random.default_rng(11)
        raw, starts, ends, h, y = [], [], [], [], []
        base = 0
        for a, b, hh, at, s, e, own in placed(pa.array(texts, pa.large_string()), LOWER):
            starts.append(s + base)
            ends.append(e + base)
            h.append(hh)
            y.append(np.repeat([self.languages.index(x) for x in langs[a:b]], np.diff(at)))
            base += int(own[-1])
        raw = LOWER[np.frombuffer("".join(texts).encode(), np.uint8)]
        starts, ends, h, y = (np.concatenate(x) for x in (starts, ends, h, y))
        if not len(h):
            return self
        _, back, (feats, _) = self.scores(raw, starts, ends, h)
        slots = np.concatenate([f[0] for f in feats])
        count = np.concatenate([f[1] for f in feats])
        off = np.concatenate(([0], np.cumsum(count)))
        g2, m2 = np.full((SLOTS, len(self.languages)), 1e-3, np.float32), np.full(self.move.shape, 1.0)
        run = 16
        runs = [np.arange(i, min(i + run, len(h))) for i in range(0, len(h), run)]
        for _ in range(EPOCHS):
            # mostly whole stretches of a document; every fourth sequence switches between documents
            order = np.arange(len(runs))
            per = LANE_WORDS // run
            whole = order[: len(order) // per * per].reshape(-1, per)
            mixed = rng.random(len(whole)) < 0.25
            flat = whole[mixed].ravel()
            whole[mixed] = rng.permutation(flat).reshape(-1, per)
            whole = whole[rng.permutation(len(whole))] if len(whole) else order[None, :]
            for i in range(0, len(whole), LANES):
                lanes = [np.concatenate([runs[r] for r in lane]) for lane in whole[i : i + LANES]]
                words = np.concatenate(lanes)
                chain = Chain(np.concatenate(([0], np.cumsum([len(x) for x in lanes]))))
                used, place = np.unique(back[words], return_inverse=True)
                idx = np.concatenate([np.arange(off[u], off[u + 1]) for u in used])
                cut = np.concatenate(([0], np.cumsum(count[used])))
                e = np.add.reduceat(self.weights[slots[idx]], cut[:-1], axis=0)[place].astype(np.float64)
                p, moved = chain.marginals(e[chain.word], self.move, True)
                grad = np.zeros_like(e)
                grad[chain.word] = -p
                gold = y[words]
                grad[np.arange(len(gold)), gold] += 1
                by_word = np.stack([np.bincount(place, grad[:, k], len(used)) for k in range(grad.shape[1])], 1)
                per_slot = np.repeat(by_word, count[used], axis=0)
                touched, where = np.unique(slots[idx], return_inverse=True)
                g = np.stack([np.bincount(where, per_slot[:, k], len(touched)) for k in range(grad.shape[1])], 1) / len(words) - RIDGE * self.weights[touched]
                g2[touched] += g * g
                self.weights[touched] += RATE * g / np.sqrt(g2[touched])
                same = np.zeros_like(moved)
                ends_of = np.cumsum([len(x) for x in lanes]) - 1
                inside = np.setdiff1d(np.arange(len(gold) - 1), ends_of)
                np.add.at(same, (gold[inside], gold[inside + 1]), 1)
                g = (same - moved) / len(words) - RIDGE * self.move
                m2 += g * g
                self.move += RATE * g / np.sqrt(m2)
        return self

    def label(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """For groups of rows: the first row, each row's mean marginals, and its spans of equally labelled words.

        Spans are arrays of row, first byte, byte after the last, label and mean marginal of the label, in order of text.
        """
        for a, b, h, at, starts, ends, own in placed(column, LOWER, GROUP):
            n, k = b - a, len(self.languages)
            if not len(h) or not k:
                none = np.zeros(0, np.int64)
                yield a, np.full((n, k), 1.0 / max(k, 1)), (none, none, none, none, np.zeros(0))
                continue
            raw = self.raw_of(column, a, b)
            e, back, (_, at_word) = self.scores(raw, starts, ends, h)
            letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
            lettered = (letters[ends[at_word]] > letters[starts[at_word]])[back]
            chain = Chain(at)
            p, _ = chain.marginals(e[back[chain.word]], self.move.astype(np.float32))
            use = lettered[chain.word]
            doc = chain.doc[use]
            total = np.stack([np.bincount(doc, p[use, x], n) for x in range(k)], 1)
            words = np.bincount(doc, minlength=n)
            best, sure = np.empty(len(h), np.int64), np.empty(len(h))
            best[chain.word], sure[chain.word] = p.argmax(1), p.max(1)
            word = np.flatnonzero(lettered)
            of, best = np.repeat(np.arange(n), np.diff(at))[word], best[word]
            first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(best) != 0))) if len(word) else word
            last = np.append(first[1:], len(word))[: len(first)] - 1
            row = of[first]
            mean = np.add.reduceat(sure[word], first) / (last - first + 1) if len(word) else np.zeros(0)
            spans = (row, starts[word[first]] - own[row], ends[word[last]] - own[row], best[first], mean.clip(0, 1))
            yield a, np.where(words[:, None] > 0, total / np.maximum(words, 1)[:, None], 1.0 / k), spans

    @staticmethod
    def raw_of(column: pa.Array, a: int, b: int) -> np.ndarray:
        from .words import text_bytes

        raw, _ = text_bytes(column.slice(a, b - a))
        return LOWER[raw]


def sample(labelled: DataFrame, text: str, lang: str, doc_id: str, per_language: int) -> tuple[list[str], list[str]]:
    """At most ``per_language`` distinct whole texts of each language, those with the least hashes of ids and texts.

    A hash bound per language, from counts, picks about twice as many; of these, each text comes to the driver once.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("language"), doc_id, text).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], []
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * per_language / n + 20 / n))]), F.col("lang"))
    share = (F.col("h").cast("double") / float(1 << 63) + 1) / 2
    got = rows.where(share <= bound).groupBy("lang", "text").agg(F.min("h").alias("h")).toPandas().sort_values(["lang", "h", "text"], kind="stable")
    got = got.groupby("lang", sort=True).head(per_language)
    return got.text.tolist(), got.lang.tolist()


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE) -> Model:
    """A model of the languages in ``labelled``, from a bounded sample of its rows; without any, it knows no language."""
    texts, langs = sample(labelled, text, lang, doc_id, per_language)
    return Model(sorted(set(langs))).train(texts, langs)


def has_letter(text: str | Column) -> Column:
    return F.coalesce(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"\p{L}")), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred, score (mean marginal of lang_pred), n_switches and spans of every row of ``docs``.

    spans has start and end (byte offsets in the text), lang and marginal (its mean over the words) of each stretch of
    words with one label, in order; words without a letter have no label. n_switches is how often the label changes.
    A null text, one without a letter, or any under a model without languages, is 'und' with score 0. Of equal
    scores the first language in order is taken. Repeated rows each get the same label; no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text).alias("_l_text"), has_letter(text).alias("_l_letter"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*carry).dtypes) + ", lang_pred string, score double, n_switches long, spans array<struct<start: long, end: long, lang: string, marginal: double>>"
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        for batch in batches:
            for a, p, spans in own.label(batch.column(k)):
                n = len(p)
                ok = batch.column(k + 1).slice(a, n).to_numpy(zero_copy_only=False).astype(bool) & bool(own.languages)
                best = p.argmax(1) if own.languages else np.zeros(n, np.int64)
                names = [own.languages[i] if o else UNKNOWN for i, o in zip(best, ok, strict=True)]
                score = np.where(ok, p[np.arange(n), best] if own.languages else 0.0, 0.0).clip(0, 1)
                row, start, end, label, marginal = (x[ok[spans[0]]] for x in spans)
                count = np.bincount(row, minlength=n)
                values = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(own.languages, pa.string()).take(pa.array(label)), pa.array(marginal)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays(values, ["start", "end", "lang", "marginal"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, n) for i in range(k)), pa.array(names), pa.array(score.astype(np.float64)), pa.array(np.maximum(count - 1, 0)), lists],
                    [*carry, "lang_pred", "score", "n_switches", "spans"],
                )

    return rows.mapInArrow(trimmed(run), schema)
