"""Whole-text encoding and decoding with files of the ``tokenizers`` library.

A text is encoded by tree concatenation. It is halved until no part is longer
than a leaf, wherever the cuts fall, also within words; the leaves of a whole batch
are encoded side by side, and then joined pair by pair: a window around each join
is encoded again by the library, and grows until its ids agree with both sides' on
a word that neither the window's edges nor the join cut. From there the ids of
the sides are spliced to those of the window.

Words recur and no token crosses white space, so a leaf's ids are put together
from those of its words, of which each is encoded once a worker; what stands at a
join always comes from its window. Where a stretch without white space is longer
than a leaf, a window would have to grow over all of it: such a stretch is never
cut by a leaf, but is a tree of its own, joined token by token.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

# The characters that \s means to the tokenizers' patterns.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = re.compile(f"[^{WHITE_SPACE}]+")
#: Characters of a leaf, and of a window at first on either side of a join.
LEAF_CHARS, WINDOW_CHARS = 1024, 32
#: Words a worker remembers: about 50 MB. The first ones it meets stay, as the
#: frequent are among them; what comes later is forgotten after its batch.
CACHE_PIECES = 250_000
#: New words encoded as one text, and the library's threads that encode such texts side by side.
JOINED_PIECES, THREADS = 1000, 2

Token = tuple[int, int, int]  # id, first character, end


def load(path: str):
    """The tokenizer of a file, or of a name among the public tokenizers; without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    from tokenizers import Tokenizer

    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _spans(encoding, shift: int = 0) -> list[Token]:
    return [(i, a + shift, b + shift) for i, (a, b) in zip(encoding.ids, encoding.offsets)]


def _anchors(tokens: list[Token]) -> dict[Token, int]:
    """Tokens that own all of their characters, which makes their place certain."""
    out = {}
    for k, t in enumerate(tokens):
        if t[1] < t[2] and (k == 0 or tokens[k - 1][2] <= t[1]) and (k + 1 == len(tokens) or tokens[k + 1][1] >= t[2]):
            out[t] = k
    return out


def _join(tokenizer, text: str, left: list[Token], right: list[Token], lo: int, mid: int, hi: int, window: int) -> list[Token]:
    """The tokens of text[lo:hi] from those of its two parts."""
    while True:
        a, b = max(lo, mid - window), min(hi, mid + window)
        middle = _spans(tokenizer.encode(text[a:b], add_special_tokens=False), a)
        if a == lo and b == hi:
            return middle
        known = _anchors(middle)
        head = tail = None
        if a == lo:
            head = (0, 0)
        else:
            at = _anchors([t for t in left if t[1] >= a])
            agreed = [t for t in known if t[2] <= mid and t[1] > a and t in at]
            if agreed:
                t = max(agreed, key=lambda t: t[1])
                head = (left.index(t), known[t])
        if b == hi:
            tail = (len(middle), len(right))
        else:
            at = _anchors([t for t in right if t[2] <= b])
            agreed = [t for t in known if t[1] >= mid and t[2] < b and t in at]
            if agreed:
                t = min(agreed, key=lambda t: t[1])
                tail = (known[t], right.index(t))
        if head and tail and head[1] <= tail[0]:
            return left[: head[0]] + middle[head[1] : tail[0]] + right[tail[1] :]
        window *= 2


def tree_encode(tokenizer, text: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> list[int]:
    """Ids of a long text without white space, by tree concatenation.

    The text is normalised first. One that would change if normalised again, or
    that holds a special token's string, is encoded in one go instead: there
    the encodings of parts mean nothing.
    """
    norm: Callable[[str], str] = tokenizer.normalizer.normalize_str if tokenizer.normalizer else (lambda t: t)
    whole = norm(text)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if len(whole) <= leaf or norm(whole) != whole or any(s in t for s in special for t in (text, whole)):
        return tokenizer.encode(text, add_special_tokens=False).ids
    bounds = [(0, len(whole))]
    while bounds[0][1] - bounds[0][0] > leaf:
        bounds = [x for lo, hi in bounds for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    leaves = tokenizer.encode_batch([whole[lo:hi] for lo, hi in bounds], add_special_tokens=False)
    level = [(lo, hi, _spans(e, lo)) for (lo, hi), e in zip(bounds, leaves)]
    while len(level) > 1:
        level = [
            (a[0], b[1], _join(tokenizer, whole, a[2], b[2], a[0], a[1], b[1], window))
            for a, b in zip(level[::2], level[1::2])
        ]
    return [t[0] for t in level[0][2]]


class WordCodec:
    """Encoder and decoder of a tokenizer whose tokens never cross white space."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> None:
        self.tokenizer = tokenizer = load(path)
        if tokenizer.decoder is not None:
            raise ValueError("the tokenizer's decoder joins tokens in a way that ids cannot be decoded apart")
        self.leaf, self.window = leaf, window
        self.stretches = re.compile(f"[^{WHITE_SPACE}]{{{leaf + 1},}}")
        #: Word -> its ids as decimals joined by spaces.
        self.cache: dict[str, str] = {}
        #: Decimal id -> what it decodes to.
        self.token_of = {str(i): tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())}
        #: What was done: texts, those of several leaves, leaves, joins, windows, and stretches that were trees of their own.
        self.done: Counter = Counter()

    def bounds(self, text: str) -> list[int]:
        """Where a text is cut into leaves: halved until they are short, but never inside a stretch that is too long for one."""
        whole = [m.span() for m in self.stretches.finditer(text)]
        cuts, open_ = [0, len(text)], [(0, len(text))]
        while open_:
            lo, hi = open_.pop()
            if hi - lo <= self.leaf:
                continue
            mid = (lo + hi) // 2
            k = bisect_left(whole, (mid, mid)) - 1
            if k >= 0 and whole[k][0] < mid < whole[k][1]:
                mid = min(whole[k], key=lambda x: (not lo < x < hi, abs(x - mid)))
            if lo < mid < hi:
                cuts.append(mid)
                open_ += [(lo, mid), (mid, hi)]
        return sorted(cuts)

    def _window(self, text: str, a: int, b: int, encoding=None) -> tuple[list[tuple[int, int]], list[str]]:
        """The places of the words of text[a:b], and their ids by the library."""
        encoding = encoding or self.tokenizer.encode(text[a:b], add_special_tokens=False)
        self.done["windows"] += 1
        places = [m.span() for m in _WORDS.finditer(text, a, b)]
        ids, firsts = list(map(str, encoding.ids)), [a + o[0] for o in encoding.offsets]
        spots = [bisect_left(firsts, lo) for lo, _ in places] + [len(ids)]
        return places, [" ".join(ids[x:y]) for x, y in zip(spots, spots[1:])]

    def _joined(self, text: str, left: list[str], right: list[str], lo: int, mid: int, hi: int, first: dict) -> list[str]:
        """The ids of the words of text[lo:hi] from those of its two halves; first holds windows that are encoded already."""
        window = self.window
        while True:
            a, b = max(lo, mid - window), min(hi, mid + window)
            places, ids = self._window(text, a, b, first.get((a, b)))
            before, after = len(_WORDS.findall(text, a, mid)), len(_WORDS.findall(text, mid, b))
            head, tail = (0, 0) if a == lo else None, (len(ids), len(right)) if b == hi else None
            if head is None:  # the last word before the join that is whole on both sides and has the same ids
                for k in range(len(places) - 1, 0, -1):
                    if places[k][1] < mid and left[k - before] == ids[k]:
                        head = (len(left) + k - before + 1, k + 1)
                        break
            if tail is None:
                for k in range(len(places) - 1):
                    if places[k][0] > mid and right[after - len(places) + k] == ids[k]:
                        tail = (k, after - len(places) + k)
                        break
            if head and tail:
                return left[: head[0]] + ids[head[1] : tail[0]] + right[tail[1] :]
            window *= 2

    def joined(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The ids of each text's words, put together from its leaves."""
        spots = []
        for text in texts:
            text = text or ""
            cuts = self.bounds(text) if len(text) > self.leaf else [0, len(text)]
            spots.append((text, cuts, [_WORDS.findall(text, lo, hi) for lo, hi in zip(cuts, cuts[1:])]))
        self._encode([leaf for _, _, leaves in spots for leaf in leaves])
        self.done.update(texts=len(spots), trees=sum(len(c) > 2 for _, c, _ in spots), leaves=sum(len(p) for _, _, p in spots))
        # The first window of every join.
        places = [(n, max(0, m - self.window), min(len(t), m + self.window)) for n, (t, cuts, _) in enumerate(spots) for m in cuts[1:-1]]
        made = self.tokenizer.encode_batch([spots[n][0][a:b] for n, a, b in places], add_special_tokens=False)
        first: list[dict] = [{} for _ in spots]
        for (n, a, b), encoding in zip(places, made):
            first[n][a, b] = encoding
        out = []
        for (text, cuts, leaves), known in zip(spots, first):
            level = [(lo, hi, list(map(self.cache.__getitem__, words))) for lo, hi, words in zip(cuts, cuts[1:], leaves)]
            while len(level) > 1:
                pairs = [
                    (lo, hi, self._joined(text, left, right, lo, mid, hi, known))
                    for (lo, mid, left), (_, hi, right) in zip(level[::2], level[1::2])
                ]
                self.done["joins"] += len(pairs)
                level = pairs + level[len(pairs) * 2 :]
            out.append(level[0][2])
        return out

    def _encode(self, cut: list[list[str]]) -> None:
        """Put the words of these lists into the cache."""
        cache = self.cache
        new = [w for w in set().union(*cut) if w not in cache]
        plain = [w for w in new if len(w) <= self.leaf and "<|" not in w]
        lots = [plain[at : at + JOINED_PIECES] for at in range(0, len(plain), JOINED_PIECES)]
        for some, got in zip(lots, self.tokenizer.encode_batch(list(map(" ".join, lots)), add_special_tokens=False)):
            ids, firsts = list(map(str, got.ids)), [o[0] for o in got.offsets]
            spots = [bisect_left(firsts, x) for x in accumulate((len(w) + 1 for w in some), initial=0)]
            cache.update((w, " ".join(ids[x:y])) for w, x, y in zip(some, spots, spots[1:]))
        for w in new:  # the long, and those that may hold a special token's string
            if w not in cache:
                self.done["stretches"] += len(w) > self.leaf
                cache[w] = " ".join(map(str, tree_encode(self.tokenizer, w, self.leaf, 2 * self.window)))

    def ids_of(self, texts: Iterable[str | None]) -> list[str]:
        """For each text its ids as decimals joined by single spaces."""
        out = [" ".join(filter(None, words)) for words in self.joined(texts)]
        for word in list(self.cache)[CACHE_PIECES:]:
            del self.cache[word]
        return out

    def decode(self, ids: str) -> str:
        """What ids, as decimals joined by single spaces, decode to."""
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec a worker, so that tasks share what it remembers."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """docs with a column ids (array of ints); a column of that name is replaced.

    Null and empty texts, and texts of white space only, get no ids.
    """
    at = docs.drop("ids").columns.index(text)

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        found = codec(path).ids_of(batch.column(at).to_pylist())
        return [pa.array([[int(i) for i in ids.split()] for ids in found], pa.list_(pa.int32()))]

    return add_columns(docs, "ids array<int>", run)


def decode(encoded: DataFrame, path: str = "word_bpe_49k.json", ids: str = "ids") -> DataFrame:
    """encoded with a column decoded, special tokens included; null ids decode to null."""
    at = encoded.drop("decoded").columns.index(ids)

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        rows = batch.column(at).to_pylist()
        out = codec(path).tokenizer.decode_batch([r or [] for r in rows], skip_special_tokens=False)
        return [pa.array([None if r is None else t for r, t in zip(rows, out)], pa.string())]

    return add_columns(encoded, "decoded string", run)


def round_trip(docs: DataFrame, path: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """docs encoded and decoded again, as digests: n_tokens, ids_sha256, decoded_sha256.

    The ids stay in the workers, so that a corpus need not be shuffled or stored
    to be checked. Columns of these names are replaced. Null counts as empty;
    an empty text has no tokens and the digest of nothing.
    """
    at = docs.drop("n_tokens", "ids_sha256", "decoded_sha256").columns.index(text)

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        c = codec(path)
        n, ids, texts = [], [], []
        for i in c.ids_of(batch.column(at).to_pylist()):
            n.append(i.count(" ") + 1 if i else 0)
            ids.append(hashlib.sha256(i.encode()).hexdigest())
            texts.append(hashlib.sha256(c.decode(i).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]

    return add_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
