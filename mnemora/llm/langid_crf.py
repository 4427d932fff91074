"""Language identification with a linear-chain conditional random field over words.

A word's features are its character n-grams (2 to 4, hashed), among them its affixes (n-grams
that hold a word border), and its entry in a lexicon of words of the training sample. Learned
transitions tie neighbours, and forward-backward gives each word a distribution over languages,
so text that switches between languages is labelled word by word. A document's language is the
one with the greatest mean probability over its words, and its score is that mean.

``train_whole`` learns from every word of every labelled text, with a pass over the text that counts
words and further ones over the words found. ``train`` takes a bounded sample: ``TRAIN_DOCS`` labelled rows, as many of each language as there
are, chosen by hashes, and of each a window of ``TRAIN_WORDS`` consecutive words (of at most
``TRAIN_CHARS`` code points), cut before it reaches the driver. This bounds the lexicon too.
Windows of two documents are spliced into one sequence, so that switches are seen. With either, every document
is labelled whole, where it is read: no shuffle. Long texts are labelled in chains of ``CHAIN``
words.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bounded_batches, discard, give_back, stash

#: Bound of the training sample: documents, and words and code points of each.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_CHARS = 4000, 40, 4000
#: Steps and rate of training, and its pull towards 0.
EPOCHS, RATE, DECAY = 40, 0.15, 1e-6
#: Steps and rate of training on whole texts (further steps change few words), the pull towards 0, and
#: the uses up to which a feature learns slowly: both the same for tables of any size.
WHOLE_EPOCHS, WHOLE_RATE, WHOLE_DECAY, FEW_USES = 12, 0.3, 0.16, 16
HASH_BITS = 16
#: Uses in the sample that make a word an entry of the lexicon.
LEXICON_USES = 3
#: Hash lanes in which the sample is drawn.
LANES = 64
#: Words that are labelled in one block; messages are carried from block to block of a text.
CHAIN = 128
#: Code points of text after which a task hands on its counts of words; words whose gradient is made
#: at once; pieces in which gradients are summed; and the grain of gradients, so that sums are exact.
COUNT_CHARS, GRADIENT_WORDS, PIECES, GRAIN = 1 << 22, 8192, 16, 2.0**20
#: Code points of new words whose features are made at once.
FEATURE_CHARS = 1 << 16
#: Words whose emissions a task remembers; longer ones than ``MEMO_CHARS`` aren't kept from one
#: slice of rows to the next.
MEMO_WORDS, MEMO_CHARS = 100_000, 64
UND = "und"
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= _P[1]
    h ^= h >> np.uint32(13)
    h *= _P[2]
    return h ^ (h >> np.uint32(16))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words (letters in lower case), where each word's begin, and a hash of
    each word."""
    text = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(c))  # symbols from here to the word's end
    grams, owners = [], []
    place = np.repeat(np.arange(len(words)), sizes)
    h = c * _P[0]
    whole = _mix(np.add.reduceat(_mix(c + (np.repeat(sizes, sizes) - left).astype(np.uint32) * _P[3]), starts))
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint32(31)) ^ (c[n - 1 :] * _P[n - 1])
        ok = left[: len(h)] >= n
        grams.append(_mix(h[ok] + np.uint32(n)) >> np.uint32(32 - HASH_BITS))
        owners.append(place[: len(h)][ok])
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    gram = gram[order]
    return gram, np.searchsorted(owner[order], np.arange(len(words))), whole


def _bucket(whole: np.ndarray) -> np.ndarray:
    """Places of words, given by their hashes, in a table of 2^HASH_BITS entries."""
    return ((whole ^ (whole >> np.uint32(16))) & np.uint32((1 << HASH_BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # 2^HASH_BITS x L
    lexicon: np.ndarray | None  # sorted hashes of words; None: every word has an entry, by its bucket
    lexical: np.ndarray  # lexicon x L, or 2^HASH_BITS x L
    trans: np.ndarray  # L x L
    start: np.ndarray  # L

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words for each language; words have letters."""
        gram, starts, whole = _features(words)
        out = np.add.reduceat(self.grams[gram], starts, axis=0)
        if self.lexicon is None:
            return out + self.lexical[_bucket(whole)]
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        known = self.lexicon[at] == whole if len(self.lexicon) else np.zeros(len(words), bool)
        out[known] += self.lexical[at[known]]
        return out


#: ASCII characters that aren't letters, to be deleted.
_OTHERS = {i: None for i in range(128) if not chr(i).isalpha()}


def letters(word: str) -> str:
    """The letters of a word, in lower case, with their marks; nothing where it has no letter
    (numerals such as ½ aren't letters)."""
    if word.isalpha():
        return word.lower()
    if word.isascii():
        return word.lower().translate(_OTHERS)
    if not any(map(str.isalpha, word)):
        return ""
    return "".join(c for c in word.lower() if c.isalpha() or unicodedata.category(c)[0] == "M")


def forward_backward(
    scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (n x T x L), expected transitions (L x L) and log likelihood's normaliser of
    chains given as scores (n x T x L); mask tells the words from the padding behind them. Chains that
    are blocks of longer ones have the message to their first word (n x L) and to their last one."""
    n, size, k = scores.shape
    peak = scores.max(2, keepdims=True)
    e = np.exp(scores - peak)
    t = np.exp(trans)
    alpha, norm = np.empty_like(e), np.ones((n, size), e.dtype)
    a = (np.exp(start) if first is None else first) * e[:, 0]
    for i in range(size):
        if i:
            a = (alpha[:, i - 1] @ t) * e[:, i]
        s = a.sum(1)
        norm[:, i] = s
        alpha[:, i] = a / s[:, None]
        if i:
            off = ~mask[:, i]
            if off.any():
                alpha[off, i] = alpha[off, i - 1]
    end = np.ones_like(e[:, 0]) if last is None else last
    beta = np.repeat(end[:, None], size, 1)
    pairs = np.zeros((k, k))
    for i in range(size - 2, -1, -1):
        nxt = e[:, i + 1] * beta[:, i + 1] / norm[:, i + 1, None]
        on = mask[:, i + 1]
        beta[:, i] = np.where(on[:, None], nxt @ t.T, end)
        pairs += np.einsum("ni,nj->ij", alpha[:, i] * on[:, None], nxt) * t
    total = float(((np.log(norm) + peak[:, :, 0]) * mask).sum())
    marginals = alpha * beta
    return marginals / np.maximum(marginals.sum(2, keepdims=True), 1e-30), pairs, total


def block_products(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """What a message becomes on its way through each block, as matrices (n x L x L, scaled): from the
    last word before the block to its last word; in blocks that open a text, from its first word."""
    e, t = np.exp(scores - scores.max(2, keepdims=True)), np.exp(trans)
    through = np.repeat(np.eye(len(t))[None], len(e), 0)
    for i in range(e.shape[1]):
        moved = through @ t
        if i == 0:
            moved[opens] = through[opens]
        step = moved * e[:, None, i]
        step /= step.sum((1, 2), keepdims=True)
        through = np.where(mask[:, i, None, None], step, through)
    return through


def carry(through: np.ndarray, opens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages to the first and to the last word of each block (n x L each); blocks stand in the
    order of their texts."""
    n, k = through.shape[:2]
    t, first, last = np.exp(trans), np.ones((n, k)), np.ones((n, k))
    a = first[0]
    for i in range(n):
        first[i] = np.exp(start) if opens[i] else a @ t
        first[i] /= first[i].sum()
        a = (first[i] if opens[i] else a) @ through[i]
        a = a / a.sum()
    for i in range(n - 2, -1, -1):
        if not opens[i + 1]:
            last[i] = through[i + 1] @ last[i + 1]
            last[i] /= last[i].sum()
    return first, last


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Model | None:
    """Train on windows of text (``TRAIN_WORDS`` words count of each) with labels; None without any."""
    windows = []
    for text, lang in zip(texts, labels, strict=True):
        words = [w for w in map(letters, (text or "").split()) if w][:TRAIN_WORDS]
        if words:
            windows.append((words, lang))
    if not windows:
        return None
    langs = sorted({lang for _, lang in windows})
    number = {x: i for i, x in enumerate(langs)}
    k, chains = len(langs), [windows[i : i + 2] for i in range(0, len(windows), 2)]
    vocab: dict[str, int] = {}
    size = 2 * TRAIN_WORDS
    ids, gold = np.zeros((len(chains), size), np.int64), np.full((len(chains), size), -1)
    for r, chain in enumerate(chains):
        at = 0
        for words, lang in chain:
            ids[r, at : at + len(words)] = [vocab.setdefault(w, len(vocab)) for w in words]
            gold[r, at : at + len(words)] = number[lang]
            at += len(words)
    mask = gold >= 0
    gram, starts, whole = _features(list(vocab))
    owner = np.repeat(np.arange(len(vocab)), np.diff(starts, append=len(gram)))
    uses = np.bincount(ids[mask], minlength=len(vocab))
    kept = np.flatnonzero(uses >= LEXICON_USES)
    lexicon, first = np.unique(whole[kept], return_index=True)
    entry = np.full(len(vocab), -1)
    entry[kept[first]] = np.arange(len(lexicon))
    has = entry >= 0
    theta = {"grams": np.zeros((1 << HASH_BITS, k)), "lexical": np.zeros((len(lexicon), k)), "trans": np.zeros((k, k)), "start": np.zeros(k)}
    hot = np.eye(k)[np.maximum(gold, 0)] * mask[:, :, None]
    seen_pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    sums = {name: np.full_like(v, 1e-8) for name, v in theta.items()}
    flat = ids[mask]
    for _ in range(epochs):
        by_word = np.stack([np.bincount(owner, theta["grams"][gram, j], len(vocab)) for j in range(k)], 1)
        by_word[has] += theta["lexical"][entry[has]]
        p, pairs, _ = forward_backward(by_word[ids], mask, theta["trans"], theta["start"])
        miss = ((p - hot) * mask[:, :, None])[mask]
        g = np.stack([np.bincount(flat, miss[:, j], len(vocab)) for j in range(k)], 1)
        grad = {
            "grams": np.stack([np.bincount(gram, g[owner, j], 1 << HASH_BITS) for j in range(k)], 1),
            "lexical": np.stack([np.bincount(entry[has], g[has, j], len(lexicon)) for j in range(k)], 1) if len(lexicon) else np.zeros((0, k)),
            "trans": pairs - seen_pairs,
            "start": (p[:, 0] - hot[:, 0]).sum(0),
        }
        for name, x in theta.items():  # AdaGrad
            step = grad[name] / len(flat) + DECAY * x
            sums[name] += step * step
            x -= RATE * step / np.sqrt(sums[name])
    return Model(langs, theta["grams"].astype(np.float32), lexicon, theta["lexical"].astype(np.float32), theta["trans"], theta["start"])


def draw(labelled: DataFrame, sample: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``h, text, lang``: at most ``sample`` rows that have id, text and language, as many of each
    language as there are. Rows that agree in all three count once.

    Only hashes are ranked, in lanes, so that no language has to meet in one task; then the few
    that are chosen pick their rows."""
    good = labelled.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    good = good.select(F.xxhash64(id_col, text_col, lang_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    keys = good.select("h", "lang", F.pmod("h", F.lit(LANES)).alias("lane"))
    r = F.dense_rank().over(W.partitionBy("lang", "lane").orderBy("h"))
    first = keys.withColumn("r", r).filter(F.col("r") <= -(-sample // LANES)).distinct()
    # ranks go round the languages, so each gets its share of the bound
    picked = first.orderBy("r", "lane", "lang").limit(sample).select(F.col("h").alias("_h"))
    return good.join(F.broadcast(picked), F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = TRAIN_DOCS) -> Model | None:
    """Train on a bounded sample of rows that have id, text and language (see ``draw``); None where
    there are none. Repeated rows count once; of a table in another order the model is the same."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    at = F.pmod("h", F.greatest(F.size("w") - TRAIN_WORDS + 1, F.lit(1)).cast("long")).cast("int") + 1
    window = F.substring(F.array_join(F.slice("w", at, TRAIN_WORDS), " "), 1, TRAIN_CHARS)
    drawn = draw(labelled, sample, id_col, text_col, lang_col).withColumn("w", words).filter(F.size("w") > 0)
    rows = sorted(tuple(r) for r in drawn.select("h", "lang", window.alias("t")).collect())
    return fit([t for _, _, t in rows], [lang for _, lang, _ in rows])


def count_words(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``form, lang, n``: how often each word (its letters) occurs in the whole texts of each language,
    in parts that are to be summed. Texts are read where they lie; counts leave a task every
    ``COUNT_CHARS`` code points."""
    bounded_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        read = 0

        def summed() -> Iterator[pa.RecordBatch]:
            while counts:
                lang, words = counts.popitem()
                forms: dict[str, int] = {}
                for w, n in words.items():
                    if f := letters(w):
                        forms[f] = forms.get(f, 0) + n
                del words
                pairs = iter(forms.items())
                while part := list(islice(pairs, BATCH_ROWS)):
                    columns = [pa.array([f for f, _ in part], pa.string()), pa.array([lang] * len(part), pa.string()), pa.array([n for _, n in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["form", "lang", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.split())
                read += len(text)
                if read > COUNT_CHARS:
                    yield from summed()
                    read = 0
        yield from summed()
        give_back()

    return labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna().mapInArrow(run, "form string, lang string, n long")


def vocabulary(counts: DataFrame, langs: list[str]) -> DataFrame:
    """A row a word: its n-grams (little-endian unsigned 32-bit integers), its bucket, and its uses in
    each of the languages (``n0``, ``n1``, ...)."""
    uses = [f"n{j}" for j in range(len(langs))]
    words = counts.groupBy("form").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(u) for u, x in zip(uses, langs, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = b.column(0).to_pylist()
            begin = chars = 0
            for i, f in enumerate(forms):
                chars += len(f)
                if chars > FEATURE_CHARS or i == len(forms) - 1:
                    gram, starts, whole = _features(forms[begin : i + 1])
                    cuts = np.append(starts, len(gram)) * 4
                    raw = gram.astype("<u4").tobytes()
                    grams = pa.array([raw[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([grams, pa.array(_bucket(whole), pa.int64()), *part.columns[1:]], ["grams", "bucket", *uses])
                    begin, chars = i + 1, 0
        give_back()

    return words.mapInArrow(run, ", ".join(["grams binary", "bucket long", *[f"{u} long" for u in uses]]))


def gradient(words: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Expected less true uses of each feature over a ``vocabulary``, with weights ``theta`` (n-grams,
    then buckets). Tasks sum what they read; pieces of these sums meet by number; the driver gets one
    array of the size of the weights. Words' shares are rounded to ``1 / GRAIN``, so no order of summing
    changes the result."""
    spark, k = words.sparkSession, theta.shape[1]
    held = spark.sparkContext.broadcast(np.ascontiguousarray(theta.T, np.float32))
    half = 1 << HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, out = held.value, np.zeros((2 * half, k))
        for whole in batches:
            for b in (whole.slice(i, GRADIENT_WORDS) for i in range(0, whole.num_rows, GRADIENT_WORDS)):
                raw = b.column(0).to_pylist()
                gram = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                bucket = b.column(1).to_numpy() + half
                uses = np.stack([c.to_numpy() for c in b.columns[2:]], 1).astype(np.float64)
                starts = np.cumsum(sizes) - sizes
                scores = np.stack([np.add.reduceat(w[gram], starts) + w[bucket] for w in weights], 1).astype(np.float64)
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                miss = np.rint((p * uses.sum(1, keepdims=True) - uses) * GRAIN)
                for j in range(k):
                    out[:half, j] += np.bincount(gram, np.repeat(miss[:, j], sizes), half)
                    out[half:, j] += np.bincount(bucket - half, miss[:, j], half)
        for i, x in enumerate(out.reshape(PIECES, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "sums"])
        del weights, out, x
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(x)
        for piece, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "sums"])
        give_back()

    shape = "piece int, sums binary"
    rows = words.mapInArrow(run, shape).repartition("piece").mapInArrow(add, shape).collect()
    held.destroy()
    return np.concatenate([np.frombuffer(bytes(r["sums"])) for r in sorted(rows)] or [np.zeros(theta.size)]).reshape(theta.shape) / GRAIN


def train_whole(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", epochs: int = WHOLE_EPOCHS) -> Model | None:
    """Train on every word of every row that has text and language; None where there are none.

    The field is trained by pieces: the weights of words to fit the languages of all uses of all words
    (a logistic regression, whose gradient needs the vocabulary with its counts, not the text), the
    transitions and starts by counting, as if the texts stood one after another in random order, two to a sequence. A transition
    is weighed against the share of its language among words, which the weights of words hold already. Rows
    count as often as they stand in the table; their order and partitions don't matter."""
    text, lang = F.col(text_col), F.col(lang_col).cast("string")
    lettered = labelled.filter(text.isNotNull() & lang.isNotNull() & text.rlike(r"\p{L}"))
    docs = dict(lettered.groupBy(lang.alias("lang")).count().collect())
    if not docs:
        return None
    langs, written = sorted(docs), []
    k = len(langs)
    words = stash(vocabulary(count_words(lettered, text_col, lang_col), langs), "vocabulary", written)
    uses = np.array(words.agg(*[F.coalesce(F.sum(f"n{j}"), F.lit(0)) for j in range(k)]).first(), np.float64)
    theta = np.zeros((2 << HASH_BITS, k))
    sums = np.full_like(theta, FEW_USES**2)
    for _ in range(epochs if k > 1 else 0):  # AdaGrad
        step = gradient(words, theta) + WHOLE_DECAY * theta
        sums += step * step
        theta -= WHOLE_RATE * step / np.sqrt(sums)
    discard(labelled.sparkSession, written)
    texts = np.array([docs[x] for x in langs], np.float64)
    pairs = np.diag(np.maximum(uses - texts, 0)) + np.outer(texts, texts) / (2 * texts.sum()) + 1 / k
    share = (uses + 1 / k) / (uses.sum() + 1)
    trans = np.log(pairs / pairs.sum(1, keepdims=True)) - np.log(share)
    start = np.log((texts + 1 / k) / (texts.sum() + 1)) - np.log(share)
    grams, lexical = theta.astype(np.float32).reshape(2, 1 << HASH_BITS, k)
    return Model(langs, grams, None, lexical, trans, start)


class Tagger:
    """Labels words of texts with a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo, self.used = model, {}, 0
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
            self.used = 0
        distinct = set(words)
        new = list(distinct.difference(memo))
        if new:
            forms = [letters(w) for w in new]
            real = [(w, f) for w, f in zip(new, forms, strict=True) if f]
            memo.update((w, 0) for w, f in zip(new, forms, strict=True) if not f)  # 0: no letters
            at = self.used + 1
            self.used += len(real)
            while len(self.table) <= self.used:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            begin = chars = 0
            for i, (_, f) in enumerate(real):
                chars += len(f)
                if chars > FEATURE_CHARS or i == len(real) - 1:
                    self.table[at + begin : at + i + 1] = self.model.emissions([f for _, f in real[begin : i + 1]])
                    begin, chars = i + 1, 0
            memo.update((w, at + i) for i, (w, _) in enumerate(real))
        ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        for w in distinct:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return ids

    def tag(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, which of its words (as split at white space) have letters, and the
        distributions of these."""
        split = [(t or "").split() for t in texts]
        ids = self._ids([w for ws in split for w in ws])
        ends = np.cumsum([len(ws) for ws in split])
        kept = [np.flatnonzero(x) for x in np.split(ids, ends[:-1])] if split else []
        chains = []  # (text, from, to) among the text's kept words
        for i, at in enumerate(kept):
            chains += [(i, j, min(j + CHAIN, len(at))) for j in range(0, len(at), CHAIN)]
        out = [np.zeros((len(at), len(self.model.langs))) for at in kept]
        begins = ends - [len(ws) for ws in split]
        trans, start = self.model.trans, self.model.start

        def scores(part: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
            size = max(b - a for _, a, b in part)
            rows, mask = np.zeros((len(part), size), np.int64), np.zeros((len(part), size), bool)
            for r, (i, a, b) in enumerate(part):
                rows[r, : b - a] = ids[begins[i] + kept[i][a:b]]
                mask[r, : b - a] = True
            return self.table[rows].astype(np.float64), mask

        messages = {}  # of blocks of texts that have several
        longer = [c for c in chains if len(kept[c[0]]) > CHAIN]
        if longer:
            opens = np.array([a == 0 for _, a, _ in longer])
            slabs = [block_products(*scores(longer[k : k + 256]), trans, opens[k : k + 256]) for k in range(0, len(longer), 256)]
            messages = dict(zip(longer, zip(*carry(np.concatenate(slabs), opens, trans, start), strict=True), strict=True))
        chains.sort(key=lambda c: c[2] - c[1])
        for k in range(0, len(chains), 256):
            part = chains[k : k + 256]
            e, mask = scores(part)
            first, last = np.tile(np.exp(start), (len(part), 1)), np.ones((len(part), len(start)))
            for r, c in enumerate(part):
                if c in messages:
                    first[r], last[r] = messages[c]
            p, _, _ = forward_backward(e, mask, trans, start, first, last)
            for r, (i, a, b) in enumerate(part):
                out[i][a:b] = p[r, : b - a]
        return list(zip(kept, out, strict=True))


def _tagged(docs: DataFrame, model: Model | None, text_col: str, name: str, kind: str, make, rows: int = 200) -> DataFrame:
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)  # HASH_BITS and the training sample bound its size
    docs = docs.drop(name)
    bounded_batches(docs.sparkSession)
    added = T._parse_datatype_string(f"{name} {kind}")
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value) if held.value is not None else None
        arrow = make(None, None, None)
        for b in batches:
            for part in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                got = tagger.tag(texts) if tagger else [(np.zeros(0, int), np.zeros((0, 0)))] * len(texts)
                made = [make(held.value, t, g) for t, g in zip(texts, got, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], [*part.schema.names, name])
        del tagger
        give_back()

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_found``, struct of ``lang`` and ``score``. Null texts and texts without a letter
    are ``und`` with score 0, as is everything without a model; of languages that tie, the first by
    name is taken. Repeated rows get equal results, an empty table gives none. Other columns pass
    through and take no part in the prediction; a column of the added name is replaced."""

    def make(model, text, got):
        if got is None:
            return pa.struct([("lang", pa.string()), ("score", pa.float64())])
        p = got[1]
        if not len(p):
            return {"lang": UND, "score": 0.0}
        mean = p.mean(0)
        best = int(mean.argmax())
        return {"lang": model.langs[best], "score": float(min(1.0, mean[best]))}

    return _tagged(docs, model, text_col, "lang_found", "struct<lang: string, score: double>", make)


def label_words(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``words``: each word that has letters, with its language and the probability of it. Null
    and empty texts have no words; else as in ``predict``."""

    def make(model, text, got):
        if got is None:
            return pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
        words = (text or "").split()
        return [{"word": words[i], "lang": model.langs[int(p.argmax())], "p": float(p.max())} for i, p in zip(got[0].tolist(), got[1], strict=True)]

    return _tagged(docs, model, text_col, "words", "array<struct<word: string, lang: string, p: double>>", make)
