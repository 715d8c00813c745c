"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary is a trie over bytes. Where no child matches, the automaton follows a failure link: it pops the longest-match
pieces that begin at the current start and goes on at the node of what is left; the number of pieces popped is stored with the
link, so a word's count is a sum along its path (linear longest-match word pieces). Counts of words already seen are looked up.

A text's words are runs without ASCII spaces; each is matched with a space in front, as byte-level vocabularies write the
beginning of a word. A byte that no piece starts with makes its word one unknown piece, as word-piece encoders do.

Defined results: a null or empty text has no tokens; repeated rows are counted each; an empty table gives no rows; extra columns are
ignored; texts are read whole.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, trimming


def rank_pieces(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Node 0 is the root. For a path w from the root: fail[w] is the node reached after popping, popped[w] the number of pieces.

    If w is itself a piece, it is popped whole and the root is next. Else its link begins with its parent's: the parent's
    pieces are popped, and more of them as long as the node reached has no child for w's last byte.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = node != 0
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    deeper.append(node)
                    if ends[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and byte not in self.next[at]:
                        at, n = self.fail[at], n + self.popped[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][byte], n
            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if a part of it matches no piece."""
        following, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for byte in word:
            while (child := following[node].get(byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


class Counter:
    def __init__(self, path: str, entries: int = 1 << 18):
        self.automaton, self.entries, self.cache = Automaton(rank_pieces(path)), entries, {}

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        cache, count = self.cache, self.automaton.count
        split = [t.split() for t in texts]
        for w in set(itertools.chain.from_iterable(split)).difference(cache):
            cache[w] = count(b" " + w)
        out = [(len(words), sum(map(cache.__getitem__, words))) for words in split]
        if len(cache) > self.entries:
            for w in list(cache)[self.entries :]:
                del cache[w]
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        for b in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            got = _counters[vocabulary](texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), type=pa.int64()), pa.array([n for n, _ in got], type=pa.int64()), pa.array([n for _, n in got], type=pa.int64())], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInArrow(trimming(run), "doc_id long, n_bytes long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
