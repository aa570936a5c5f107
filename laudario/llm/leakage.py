"""Evaluation passages inside a corpus: latent semantic retrieval, then alignment.

1. Statistics over all documents: document frequencies of all words. The vocabulary of the latent space
   is the words of the evaluation items and the `VOCABULARY` most frequent ones of the corpus.
2. A distributed randomised SVD of TF-IDF passages: a random start, `POWER` rounds of power iteration
   Z = A'(A Q) with Q orthonormal, then the projected matrix Q'A'AQ, whose eigenvectors turn Q into the
   singular vectors. Partitions add up their shares of Z by blocks of words; what comes to the driver is
   (VOCABULARY + words of a block of items) x (RANK + SPARE) numbers, whatever the corpus. This index
   is fitted on the passages of at most `SAMPLE` different documents and of the items; it then covers all.
3. Every document, in whole, is cut into windows of `WINDOW` words, one every `STRIDE`. Inverted lists of
   the items' pairs of neighbouring words give the items that a document may hold: an alignment of score
   s has s - 1 such pairs at least, and `PAIRS` of them lie within a window, so no window meets all items. These
   windows are compared with the item's windows by cosine in the latent space. Nothing is shuffled.
4. A candidate must share a longest common subsequence with the item, and its document and the item are
   then aligned locally by words. Scores in between are decided by an answer check: the numbers and
   rare words of the item's aligned part must be there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laudario.llm import wordhash
from laudario.session import cut, spread

WINDOW, STRIDE = 16, 4
ITEM_WINDOW, ITEM_STRIDE = 20, 4
VOCABULARY = 12_000  # most frequent words of the corpus in the latent space, beside those of the items
RANK, SPARE, POWER = 64, 16, 2
SAMPLE = 20_000  # different documents whose passages the latent space is fitted on, at most
SEED = 11
COSINE = 0.55  # least latent cosine of a candidate window
SUBSEQUENCE = 11  # least longest common subsequence of a candidate window with its item
SURE, MAYBE = 18, 14  # alignment scores: a leak, and a leak if the answer check holds
RARE_SHARE = 2000  # the answer check asks for words of at most this part of all documents
PAIRS = 5  # a window of 16 words, 11 of them matched, has as many pairs of matched neighbours at least
BLOCK_ITEMS, BLOCK_WORDS = 500, 50_000  # items searched at once; more are searched in blocks
_STEP = 512  # documents at a time


class Index:
    """A block of evaluation items as word ids and windows, and the vocabulary as sorted hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], frequent: np.ndarray | None = None):
        self.ids = [i for i, _ in items]
        own = [w for _, w in items] + [np.zeros(0, np.uint64) if frequent is None else frequent]
        self.hashes = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.items = [np.searchsorted(self.hashes, w).astype(np.int32) for _, w in items]
        self.windows: list[tuple[int, np.ndarray]] = []
        for i, w in enumerate(self.items):
            last = max(0, len(w) - ITEM_WINDOW)
            for s in sorted({*range(0, last + 1, ITEM_STRIDE), last}):
                if len(w[s : s + ITEM_WINDOW]):
                    self.windows.append((i, w[s : s + ITEM_WINDOW]))
        owner = np.array([i for i, _ in self.windows], np.int64)
        self.first = np.searchsorted(owner, np.arange(len(self.items) + 1))
        # Inverted lists: for each pair of neighbouring words the items that hold it. An item of one word is a pair with itself.
        pairs = [np.unique(self.pair(w[:-1], w[1:]) if len(w) > 1 else self.pair(w, w)) for w in self.items]
        word = np.concatenate([*pairs, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]).astype(np.int32)
        order = np.argsort(word, kind="stable")
        self.postings = item[order]
        self.pairs, self.posting_start = np.unique(word[order], return_index=True)
        self.posting_size = np.diff(np.append(self.posting_start, len(order)))
        self.maybe = np.zeros(1 << 20, bool)  # most pairs of a corpus are told here not to be an item's
        self.maybe[self.spot(self.pairs)] = True
        # Which item has which word; the first column is for unknown words. Bounded by a block's items and words.
        self.member = np.zeros((len(self.items), len(self.hashes) + 1), bool)
        for i, w in enumerate(self.items):
            self.member[i, w + 1] = True
        self.least = np.array([min(SUBSEQUENCE, len(w)) for w in self.items], np.int32)
        self.single = np.unique(np.concatenate([*[w for w in self.items if len(w) == 1], np.zeros(0, np.int32)]))
        self.sure = np.array([sure(len(w)) for w in self.items], np.int32)
        self.need = np.maximum(1, np.minimum(self.sure, MAYBE) - 1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * (len(self.hashes) + 1) + b

    def spot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word ids, -1 for words that are not in the vocabulary; first word of each text and the end)."""
        hashes, bounds = wordhash.words(texts)
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32), bounds
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int32), bounds

    def fit(self, counts: np.ndarray, documents: int) -> None:
        self.idf = (np.log((documents + 1) / (counts + 1)) + 1).astype(np.float32)
        self.rare = counts * RARE_SHARE <= documents

    def project(self, vectors: np.ndarray) -> None:
        """Item windows in the latent space, as unit vectors."""
        self.basis = (vectors * self.idf[:, None]).astype(np.float32)
        out = np.stack([self.basis[w].sum(0) for _, w in self.windows]) if self.windows else np.zeros((0, vectors.shape[1]), np.float32)
        self.latent = (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def sure(length: int) -> int:
    """The least score that makes an item a leak by itself: one shorter than that must be there as a whole, two words aside from nine on."""
    return min(SURE, length - 2 if length > 8 else length)


def gram_share(ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A Q) of the passages (blocks of WINDOW words) of some texts to `total`."""
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return
    text = np.searchsorted(bounds, known, side="right") - 1
    # passages are numbered through all texts
    sizes = -(-np.diff(bounds) // WINDOW)
    passage = (np.concatenate([[0], np.cumsum(sizes)])[text] + (known - bounds[text]) // WINDOW).astype(np.int64)
    word = ids[known]
    weight = idf[word]
    new = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    sums = np.add.reduceat(q[word] * weight[:, None], new, axis=0)
    where = np.cumsum(np.concatenate([[False], passage[1:] != passage[:-1]]))
    order = np.argsort(word, kind="stable")
    word = word[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total[word[starts]] += np.add.reduceat(sums[where[order]] * weight[order, None], starts, axis=0)


def orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by two rounds over the small matrix of their products."""
    for _ in range(2):
        values, turn = np.linalg.eigh((y.T @ y).astype(np.float64))
        good = values > max(values[-1], 0) * 1e-10
        if not good.any():
            return np.zeros((len(y), 0), np.float32)
        y = (y @ (turn[:, good] / np.sqrt(values[good]))).astype(np.float32)
    return y


def subsequence(a: list[int], bits: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence, bit-parallel; `bits` has the positions of each word of the other text."""
    v = full = (1 << size) - 1
    for x in a:
        u = v & bits.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def align(regions: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores (match 1, change, drop and addition -1) of many pairs at once."""
    if not regions:
        return np.zeros(0, np.float32)
    width, height = max(map(len, items)), max(map(len, regions))
    it = np.full((len(items), width), -3, np.int32)
    for r, w in enumerate(items):
        it[r, : len(w)] = w
    doc = np.full((len(regions), height), -2, np.int32)
    for r, w in enumerate(regions):
        doc[r, : len(w)] = w
    # Scores are at most the length of an item or a text, and small numbers take few bytes.
    kind = np.int16 if width < 30_000 else np.int32
    h = np.zeros((len(items), width + 1), kind)
    best = np.zeros(len(items), kind)
    step = np.arange(width + 1, dtype=kind)
    for k in range(height):
        new = np.zeros_like(h)
        gain = ((it == doc[:, k : k + 1]).astype(np.int8) << 1) - 1
        np.maximum(h[:, :-1] + gain, h[:, 1:] - 1, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new += step
        np.maximum.accumulate(new, axis=1, out=new)
        new -= step
        h = new
        np.maximum(best, h.max(1), out=best)
    return best


def answers(region: np.ndarray, item: np.ndarray, rare: np.ndarray) -> bool:
    """Whether the item's part under the best local alignment keeps its numbers and rare words, three at least."""
    n, m = len(region), len(item)
    h = np.zeros((n + 1, m + 1), np.int32)
    step = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = h[i]
        np.maximum(h[i - 1, :-1] + np.where(item == region[i - 1], 1, -1), h[i - 1, 1:] - 1, out=row[1:])
        np.maximum(row, 0, out=row)
        # a gap in the item costs one a word: running maxima of the scores without that cost
        np.maximum.accumulate(row + step, out=row)
        row -= step
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    end, hit = j, set()
    while i and j and h[i, j]:
        s = 1 if region[i - 1] == item[j - 1] else -1
        if h[i, j] == h[i - 1, j - 1] + s:
            if s == 1:
                hit.add(j - 1)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    asked = [k for k in range(j, end) if rare[item[k]]]
    return len(asked) >= 3 and end - j >= ITEM_WINDOW and all(k in hit for k in asked)


class Searcher:
    """Finds the items that documents hold; one for each Python worker."""

    def __init__(self, index: Index):
        self.x = index
        self.bits = []
        for w in index.items:
            b: dict[int, int] = defaultdict(int)
            for p, v in enumerate(w.tolist()):
                b[v] |= 1 << p
            self.bits.append(dict(b))

    def hits(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place) of the word pairs that texts share with items, where a text and an item share enough in all and `PAIRS` from there on within a window."""
        x = self.x
        none = np.zeros(0, np.int64)
        if not len(ids):
            return none, none, none
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (text[:-1] == text[1:])
        place = np.flatnonzero(both)
        key = x.pair(ids[place], ids[place + 1])
        if len(x.single):
            alone = np.flatnonzero(np.isin(ids, x.single))
            place, key = np.concatenate([place, alone]), np.concatenate([key, x.pair(ids[alone], ids[alone])])
        hopeful = x.maybe[x.spot(key)]
        place, key = place[hopeful], key[hopeful]
        if not len(place) or not len(x.pairs):
            return none, none, none
        at = np.minimum(np.searchsorted(x.pairs, key), len(x.pairs) - 1)
        there = x.pairs[at] == key
        at, place = at[there], place[there]
        size = x.posting_size[at]
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x.posting_start[at], size)
        place, item = np.repeat(place, size), x.postings[flat].astype(np.int64)
        # Only pairs that share enough in all, and of these the places where a window's length holds enough.
        both = text[place] * len(x.items) + item
        # places ascend already, but for those of items of one word
        order = np.lexsort((place, both)) if len(x.single) else np.argsort(both, kind="stable")
        both = both[order]
        runs = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1], [True]]))
        runs = np.repeat(np.diff(runs), np.diff(runs))
        enough = runs >= x.need[both % len(x.items)]
        both, place = both[enough], place[order[enough]]
        if not len(both):
            return none, none, none
        item = both % len(x.items)
        line = both * (len(ids) + WINDOW) + place
        last = np.arange(len(line)) + np.minimum(PAIRS, x.need[item]) - 1
        keep = (last < len(line)) & (line[np.minimum(last, len(line) - 1)] - line < WINDOW - 1)
        if not keep.any():
            return none, none, none
        some = np.unique(both[keep])
        good = some[self.most(ids, bounds, some, both, place) >= np.minimum(x.sure, MAYBE)[some % len(x.items)]]
        keep &= np.isin(both, good)
        return text[place[keep]], item[keep], place[keep]

    def most(self, ids: np.ndarray, bounds: np.ndarray, some: np.ndarray, both: np.ndarray, place: np.ndarray) -> np.ndarray:
        """An upper bound of the alignment score of some texts and items (text x items + item), from their shared pairs.

        A word of a shared pair may be a match (1). Another word of the item may be a match on its own
        (1), but where it follows a word of the item without a shared pair, an edit lies between (0). Any
        other word is an edit (-1). The greatest sum of a stretch of the text bounds the score.
        """
        x = self.x
        text, item = some // len(x.items), some % len(x.items)
        length = np.diff(bounds)[text]
        base = np.cumsum(length) - length
        flat = np.arange(length.sum()) - np.repeat(base - bounds[text], length)
        has = x.member[np.repeat(item, length), ids[flat] + 1]
        fresh = np.concatenate([[True], ~has[:-1]])
        fresh[base] = True
        value = np.where(has, fresh, -1).astype(np.int64)
        at = np.minimum(np.searchsorted(some, both), len(some) - 1)
        mine = some[at] == both
        spot = base[at[mine]] + place[mine] - bounds[text[at[mine]]]
        value[spot] = 1
        value[np.minimum(spot + 1, (base + length)[at[mine]] - 1)] = 1
        # Greatest sums of stretches: running sums less their least value before, apart for each pair.
        apart = np.repeat(np.arange(len(some)), length) * (2 * len(flat) + 2)
        total = np.cumsum(value)
        low = np.minimum.accumulate(total - value - apart)
        return np.maximum.reduceat(total - apart - low, base)

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> first words of the windows that hold a shared pair and are near a window of the item."""
        x = self.x
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        text, item, place = self.hits(ids, bounds)
        if not len(text):
            return found
        # The windows that begin at the place's block of STRIDE words, at the one before and the one after.
        start = (((place - bounds[text]) // STRIDE)[:, None] + np.array([-1, 0, 1])).ravel() * STRIDE
        item, text = np.repeat(item, 3), np.repeat(text, 3)
        inside = (start >= 0) & (start < np.diff(bounds)[text])
        longest = int(np.diff(bounds).max()) + 1
        code = np.unique(((item * len(bounds) + text) * longest + start)[inside])
        start, code = code % longest, code // longest
        item, text = code // len(bounds), code % len(bounds)
        # Windows with fewer of the item's words than the common subsequence needs can't pass it.
        place = bounds[text] + start
        at = place[:, None] + np.arange(WINDOW)
        word = np.where(at < bounds[1:][text][:, None], ids[np.minimum(at, len(ids) - 1)], -1)
        keep = x.member[item[:, None], word + 1].sum(1) >= x.least[item]
        if not keep.any():
            return found
        item, text, start, place, word = item[keep], text[keep], start[keep], place[keep], word[keep]
        # A window that leads to several items is projected once.
        _, one, back = np.unique(place, return_index=True, return_inverse=True)
        different, word = place[one], word[one]
        unit = np.empty((len(different), x.basis.shape[1]), np.float32)
        for b in range(0, len(different), 4096):
            part = word[b : b + 4096]
            sums = (x.basis[np.maximum(part, 0)] * (part >= 0)[:, :, None]).sum(1)
            unit[b : b + 4096] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        vec = unit[back]
        edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            i = int(item[a])
            near = (vec[a:b] @ x.latent[x.first[i] : x.first[i + 1]].T).max(1)
            for k in np.flatnonzero(near >= COSINE):
                found[int(text[a + k]), i].append(int(start[a + k]))
        return found

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item, score) of each leak."""
        pairs, regions, items = [], [], []
        for (d, i), starts in self.candidates(ids, bounds).items():
            own = ids[bounds[d] : bounds[d + 1]]
            as_list = own.tolist()
            size = len(self.x.items[i])
            good = [s for s in starts if subsequence(as_list[s : s + WINDOW], self.bits[i], size) >= min(SUBSEQUENCE, size)]
            if good:
                # windows far apart are separate places; each is aligned with room for the whole item
                good.sort()
                group = [good[0]]
                for s in [*good[1:], None]:
                    if s is None or s - group[-1] > size:
                        pairs.append((d, i))
                        regions.append(own[max(0, group[0] - size - 8) : group[-1] + WINDOW + size + 8])
                        items.append(self.x.items[i])
                        group = []
                    group.append(s)
        order = sorted(range(len(pairs)), key=lambda k: len(regions[k]))
        out: dict[tuple[int, int], float] = {}
        for b in range(0, len(order), 512):
            some = order[b : b + 512]
            for k, score in zip(some, align([regions[k] for k in some], [items[k] for k in some])):
                # an item shorter than the sure score leaks when it is there as a whole
                if score >= self.x.sure[pairs[k][1]] or score >= MAYBE and answers(regions[k], items[k], self.x.rare):
                    out[pairs[k]] = max(float(score), out.get(pairs[k], 0))
        return [(d, i, s) for (d, i), s in out.items()]


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def document_frequencies(documents: DataFrame, text: str) -> DataFrame:
    """(word, n): the documents that hold each word, counted over the whole corpus; word 0 stands for all documents.

    Each partition adds up what it has seen and hands on at most a million words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, parts, held = 0, [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
            word, back = np.unique(every, return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts] or [np.zeros(0)]), len(word)).astype(np.int64)
            return pa.RecordBatch.from_arrays([_signed(np.concatenate([[np.uint64(0)], word]).astype(np.uint64)), pa.array(np.concatenate([[documents], n]))], names=["word", "n"])

        for batch in batches:
            for b in range(0, batch.num_rows, 1024):
                some = batch.column(0).slice(b, 1024)
                documents += len(some)
                hashes, bounds = wordhash.words(some)
                word, back = np.unique(hashes, return_inverse=True)
                owner = np.repeat(np.arange(len(some)), np.diff(bounds))
                once = np.unique(owner * max(1, len(word)) + back) % max(1, len(word))
                parts.append((word, np.bincount(once, minlength=len(word))))
                held += len(word)
                if held > 1_000_000:
                    yield flush()
                    documents, parts, held = 0, [], 0
        yield flush()

    return spread(documents.select(text)).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def sample_of(documents: DataFrame, text: str, total: int, sample: int) -> DataFrame:
    """At most about `sample` different texts, by a bound on their hash."""
    bound = int(min(1.0, sample / max(total, 1)) * 1_000_003)
    return documents.where(F.length(text) > 0).select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.lit(SEED), F.col("text")), F.lit(1_000_003)) <= bound).distinct()


def singular_vectors(passages: DataFrame, index: Index, own: tuple[np.ndarray, np.ndarray], rank: int = RANK, spare: int = SPARE, power: int = POWER, blocks: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(words x rank right singular vectors, singular values) of the TF-IDF passages of the encoded texts and the items.

    `passages` has the columns ids and bounds, little-endian numbers as binary; `own` are the items' word ids
    and bounds. The items' passages weigh as much as the corpus, so that their rare words are in the space.
    """
    d = len(index.hashes)
    k = min(rank + spare, d)
    context = passages.sparkSession.sparkContext
    edges = np.linspace(0, d, blocks + 1).astype(int)
    idf = context.broadcast(index.idf)

    def step(q: np.ndarray) -> np.ndarray:
        shared = context.broadcast(q)

        def run(batches):
            basis, total, any_, salt = shared.value, np.zeros_like(shared.value), False, 0
            for batch in batches:
                for ids, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    gram_share(np.frombuffer(ids, np.int32), np.frombuffer(bounds, np.int64), idf.value, basis, total)
                    any_, salt = True, salt ^ len(ids)
            if any_:
                for b in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt % 97], pa.int32()), pa.array([total[edges[b] : edges[b + 1]].tobytes()], pa.binary())], names=["block", "salt", "share"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(len(pdf["share"].iloc[0]) // 4, np.float32)
            for s in pdf["share"]:
                out += np.frombuffer(s, np.float32)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "share": [out.tobytes()]})

        schema = "block int, salt int, share binary"
        shares = passages.select("ids", "bounds").mapInArrow(run, schema)
        shares = shares.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
        total = np.zeros(q.shape, np.float32)
        for r in shares.collect():  # `blocks` rows of words x (rank + spare) numbers together
            total[edges[r["block"]] : edges[r["block"] + 1]] = np.frombuffer(r["share"], np.float32).reshape(-1, q.shape[1])
        shared.unpersist()
        mine = np.zeros(q.shape, np.float32)
        gram_share(*own, index.idf, q, mine)
        a, b = np.linalg.norm(total), np.linalg.norm(mine)
        return total + mine * (a / b if a and b else 1.0)

    y = np.random.default_rng(SEED).standard_normal((d, k), dtype=np.float32)
    for _ in range(power):
        y = step(orthonormal(y))
    q = orthonormal(y)
    z = step(q)
    values, turn = np.linalg.eigh((q.T @ z).astype(np.float64))
    order = np.argsort(-values)[:rank]
    return (q @ turn[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0))


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of bounded size, read one partition at a time; items without a word are left out."""
    block, held = [], 0
    for row in items.where(F.col(item_text).isNotNull()).select(item_key, item_text).orderBy(item_key).toLocalIterator():
        hashes, _ = wordhash.words(pa.array([row[1]]))
        if not len(hashes):
            continue
        if block and (len(block) >= BLOCK_ITEMS or held + len(hashes) > BLOCK_WORDS):
            yield block
            block, held = [], 0
        block.append((row[0], hashes))
        held += len(hashes)
    if block:
        yield block


def fit(documents: DataFrame, text: str, counts: DataFrame, block: list[tuple[int, np.ndarray]], total: int, frequent: np.ndarray, sample: DataFrame) -> Index:
    """The index of a block of items: document frequencies of its vocabulary and the latent space."""
    spark = documents.sparkSession
    index = Index(block, frequent)
    wanted = spark.createDataFrame(pd.DataFrame({"word": index.hashes.view(np.int64)}))  # bounded by VOCABULARY and BLOCK_WORDS
    n = np.zeros(len(index.hashes), np.int64)
    for r in counts.join(F.broadcast(wanted), "word").collect():
        n[np.searchsorted(index.hashes, np.int64(r["word"]).view(np.uint64))] = r["n"]
    index.fit(n, total)
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for b in range(0, batch.num_rows, _STEP):
                ids, bounds = shared.value.encode(batch.column(0).slice(b, _STEP))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([bounds.astype(np.int64).tobytes()], pa.binary())], names=["ids", "bounds"])

    encoded = cut(sample.mapInArrow(run, "ids binary, bounds binary"))
    shifts = [w[s:] for s in range(0, WINDOW, STRIDE) for w in index.items]
    own = np.concatenate(shifts), np.concatenate([[0], np.cumsum([len(w) for w in shifts])])
    index.project(singular_vectors(encoded, index, own)[0])
    return index


def leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score) of every document that holds a passage of an item.

    NULL, empty and blank texts hold and leak nothing; copies count each. Items come to the driver in
    blocks of bounded size; each block is searched against all documents.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, score double"
    counts, total, out = None, 0, None
    for block in _blocks(items, item_key, item_text):
        if counts is None:
            counts = cut(document_frequencies(documents, text))
            total = counts.where("word = 0").agg(F.sum("n")).first()[0] or 0
            top = counts.where("word != 0").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
            frequent = np.array([r["word"] for r in top], np.int64).view(np.uint64)
            sample = cut(sample_of(documents, text, total, SAMPLE))
        shared = spark.sparkContext.broadcast(fit(documents, text, counts, block, total, frequent, sample))

        def run(batches, shared=shared):
            index = shared.value
            searcher = Searcher(index)
            for batch in batches:
                keys = batch.column(0)
                for b in range(0, batch.num_rows, _STEP):
                    found = searcher.search(*index.encode(batch.column(1).slice(b, _STEP)))
                    if found:
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array([b + d for d, _, _ in found])).cast(pa.int64()), pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "item_id", "score"])

        part = spread(documents.select(F.col(key).cast("bigint"), text).where(F.length(text) > 0)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def p7_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")
