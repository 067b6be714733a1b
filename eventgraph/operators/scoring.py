"""BM25+ over a block of documents, for Arrow batches: words are counted, whole sets of queries scored, the best kept.

What leaves a block is k rows for each query, never a row for each query and document. A block's documents have
places from 0; its lists (a word's documents and how often it comes in each) lie one after another.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B, DELTA = 1.5, 0.75, 1.0
PLACES = 9


#: Letters and digits in lower case, everything else a space.
_SIGNS = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))
_BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]+")


def folded(texts: pa.Array) -> pa.Array:
    """Texts (null: empty) as ``text.search_text`` has them, but for the number of spaces; Python's own tables are many times faster over whole texts."""
    plain = lambda t: t if t.isascii() else unicodedata.normalize("NFKD", _BEYOND_BASIC.sub("", t))
    return pa.array([plain(t or "").encode("ascii", "ignore").translate(_SIGNS) for t in texts.to_pylist()], pa.binary()).cast(pa.string())


def counted(texts: pa.Array, places: np.ndarray, size: int, vocabulary: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and then codes of words, places and counts in order of both, and the length by place.

    places says whose text each is, below size. With a vocabulary only its words are listed, by their place
    in it; lengths count all words.
    """
    words = pc.ascii_split_whitespace(folded(texts))
    flat, owner = words.flatten(), np.repeat(places, np.diff(words.offsets.to_numpy()))
    some = pc.not_equal(flat, "")  # spaces at an end
    flat, owner = flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(owner, minlength=size)
    if vocabulary is None:
        coded = flat.dictionary_encode()
        vocabulary, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    else:
        codes = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy().astype(np.int64)
        codes, owner = codes[codes >= 0], owner[codes >= 0]
    keys, counts = np.unique(codes * size + owner, return_counts=True)
    return vocabulary, keys // size, keys % size, counts, lengths


def gains(counts: np.ndarray, lengths: np.ndarray, average: float) -> np.ndarray:
    """What a word adds to a document's score for each unit of its weight, beyond the baseline."""
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / average))


class Asked:
    """Queries as arrays: their ids, and for each the words and weights that are known, and its baseline."""

    def __init__(self, rows: pa.Table):
        """rows: query_id, token, weight, average and base (the same in all rows of a query); a row for each word of a query."""
        rows = rows.combine_chunks()
        self.average = rows.column("average")[0].as_py() if rows.num_rows else 1.0
        token, query = (rows.column(c).combine_chunks().dictionary_encode() for c in ("token", "query_id"))
        self.words, self.ids = token.dictionary, query.dictionary
        which = pc.fill_null(query.indices, len(self.ids)).to_numpy()  # a null id is a query like others
        if query.indices.null_count:
            self.ids = pa.concat_arrays([self.ids, pa.nulls(1, self.ids.type)])
        words, weights = token.indices.to_numpy(), rows.column("weight").to_numpy()
        order = np.lexsort((words, which))
        self.word, self.weight = words[order], weights[order]
        self.ends = np.searchsorted(which[order], np.arange(len(self.ids)), "right")
        self.base = rows.column("base").to_numpy()[order][self.ends - 1]

    def scores(self, first: np.ndarray, last: np.ndarray, docs: np.ndarray, gained: np.ndarray, offered: np.ndarray):
        """For each query: its number, the offered places with one of its words, and their scores beyond the baseline.

        The list of a word lies from first to last (by word; equal where there is none) in docs and gained.
        """
        begin = 0
        for number, end in enumerate(self.ends):
            sums = np.zeros(len(offered))
            for word, weight in zip(self.word[begin:end], self.weight[begin:end]):
                at = slice(first[word], last[word])
                sums[docs[at]] += weight * gained[at]
            begin = end
            places = np.flatnonzero((sums > 0) & offered)
            yield number, places, sums[places]


class Leading:
    """The k best (score, id) of each query so far; ties in order of id, null first."""

    def __init__(self, n: int, k: int, ids: pa.DataType):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [pa.array([], ids)] * n

    def take(self, query: int, scores: np.ndarray, ids: pa.Array, places: np.ndarray) -> None:
        """ids is the block's, places are those that the scores are of."""
        held = self.scores[query]
        if len(held) == self.k:
            better = scores >= held[-1]
            scores, places = scores[better], places[better]
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]  # with all that tie at the end
            scores, places = scores[near], places[near]
        if not len(scores):
            return
        scores, ids = np.concatenate([held, scores]), pa.concat_arrays([self.ids[query], ids.take(pa.array(places))])
        order = pc.sort_indices(pa.table({"score": scores, "id": ids}), sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_start")[: self.k]
        self.scores[query], self.ids[query] = scores[order.to_numpy()], ids.take(order)

    def rows(self, queries: pa.Array) -> pa.RecordBatch:
        which = pa.array(np.repeat(np.arange(len(self.scores)), [len(s) for s in self.scores]))
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([queries.take(which), ids, pa.array(np.concatenate([np.zeros(0), *self.scores]))], ["query_id", "doc_id", "score"])
