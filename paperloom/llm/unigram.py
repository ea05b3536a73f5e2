"""Token counts of texts under a unigram model, by dynamic programming shared in a trie.

A text's pre-tokens are its words, each with a word mark in front. The best
segmentation of a pre-token is the one of the largest sum of piece scores (then
of the fewest pieces). The best score up to a place in a word depends on the
letters before it only, so distinct pre-tokens are inserted in a trie and the
forward step is done once for each node: words share the work of their common
prefixes. A word's count is stored at its terminal, and a text's is their sum.

A file of a BPE model holds ranks of merges in place of scores. For a unigram
model over its pieces, ``fit`` estimates their log probabilities: all words of
all texts are cut as the file's own model cuts them, and pieces counted.
"""

from __future__ import annotations

import collections
import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE
from .common import add_columns, release, small_batches

MARK = "▁"
#: How much worse a byte of an unknown character scores than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers: the first ones it meets, as the frequent are among them.
CACHE_WORDS = 300_000
#: Distinct words a task of fit holds before it cuts them into pieces.
HELD_WORDS = 100_000
_WORDS = re.compile(f"[^{WHITE_SPACE}]+")


def _model(path: str):
    import sentencepiece

    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _ordinary(model) -> dict[int, str]:
    """Ids and pieces of a sentencepiece model; without control, unknown, unused and byte pieces."""
    odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return {i: model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)}


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores as a sentencepiece model's file has them; log probabilities if it is a unigram model."""
    model = _model(path)
    return {piece: model.get_score(i) for i, piece in _ordinary(model).items()}


@dataclass(frozen=True)
class UnigramModel:
    """Pieces and their log probabilities, under a name of its own."""

    pieces: dict[str, float]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(docs: DataFrame, path: str = "piece_bpe_32k.model", text: str = "text") -> UnigramModel:
    """Log probabilities of a file's pieces, from their counts over all words of all texts.

    Every word is cut by the file's own model, and every piece counted once more
    than it occurs. Tasks add pieces up, whatever the number of distinct words;
    the driver gets one sum a piece.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        total = np.zeros(model.get_piece_size(), np.int64)
        held: collections.Counter = collections.Counter()

        def add() -> None:
            words = list(held)
            cut = model.encode(words, num_threads=1)
            ids = np.fromiter((i for c in cut for i in c), np.int64)
            times = np.repeat(np.fromiter(map(held.__getitem__, words), np.int64, len(words)), np.fromiter(map(len, cut), np.int64, len(cut)))
            np.add.at(total, ids, times)
            held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(_WORDS.findall(t))
            if len(held) > HELD_WORDS:
                add()
        if held:
            add()
        hit = np.flatnonzero(total)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["piece", "n"])
        release()

    found = docs.select(text).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    seen = {r["piece"]: r["n"] for r in found}
    counts = {piece: seen.get(i, 0) + 1 for i, piece in _ordinary(_model(path)).items()}
    whole = math.log(sum(counts.values())) if counts else 0.0
    return UnigramModel({piece: math.log(n) - whole for piece, n in counts.items()})


class Counter:
    """Counts of pre-tokens under a set of scored pieces."""

    def __init__(self, pieces: dict[str, float]) -> None:
        # Every ending of a piece, with the score of the one that it is itself: no piece ends with what is not here.
        self.endings: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(1, len(p))}
        self.endings.update(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}
        #: Forward steps done: nodes of the tries that were walked.
        self.nodes = 0

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """The number of tokens of each distinct word.

        A word shares with the one before it, in order, the nodes of the trie
        on their common prefix; what is known of them is kept by depth.
        """
        out: dict[str, int] = {}
        score, count = [0.0], [0]
        path = ""
        longest = self.longest
        for word in sorted(words):
            letters = MARK + word
            shared = len(os.path.commonprefix([path, letters]))
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(letters) + 1):
                best, fewest = self._step(letters[max(0, end - longest) : end], score, count)
                score.append(best)
                count.append(fewest)
            self.nodes += len(letters) - shared
            out[word] = count[-1]
            path = letters
        return out

    def _step(self, tail: str, score: list[float], count: list[int]) -> tuple[float, int]:
        """The forward step: the best way to end at this node with one more token."""
        n = 1 if tail[-1] < "\x80" else len(tail[-1].encode("utf-8", "surrogatepass"))
        best, fewest = score[-1] + n * self.unknown, count[-1] + n
        endings = self.endings
        for size in range(1, len(tail) + 1):
            ending = tail[-size:]
            if ending not in endings:
                break
            own = endings[ending]
            if own is not None:
                total, k = score[-size] + own, count[-size] + 1
                if total > best or (total == best and k < fewest):
                    best, fewest = total, k
        return best, fewest

    def totals(self, texts: Sequence[str | None]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        cut = [_WORDS.findall(t) if t else [] for t in texts]
        cache = self.cache
        new = [w for w in set().union(*cut) if w not in cache]
        cache.update(self.counts(new))
        out = [(len(c), sum(map(cache.__getitem__, c))) for c in cut]
        for word in new[max(0, CACHE_WORDS - len(cache) + len(new)) :]:
            del cache[word]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str, pieces: dict[str, float] | None = None) -> Counter:
    """The worker's counter of a file's scores, or of pieces under the name path; of these, the last one only."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(load_pieces(path) if pieces is None else pieces)
    return _counters[path]


def token_counts(docs: DataFrame, path: str = "piece_bpe_32k.model", text: str = "text", model: UnigramModel | None = None) -> DataFrame:
    """docs with n_pretokens and n_tokens, under a model or a file's own scores; columns of these names are replaced.

    Null, empty and blank texts have none of either. Repeated rows get equal
    counts. A character that no piece covers counts one token for each byte.
    """
    at = docs.drop("n_pretokens", "n_tokens").columns.index(text)
    name = path if model is None else model.name
    dealt = None if model is None else docs.sparkSession.sparkContext.broadcast(model.pieces)

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        own = counter(name, None if dealt is None else dealt.value)
        found = own.totals(batch.column(at).to_pylist())
        return [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]

    return add_columns(docs, "n_pretokens long, n_tokens long", run)
