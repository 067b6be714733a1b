"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For a merge-type model the tokens of any prefix of a text are unique, and the encoding of a text
without its last token's characters is its encoding without its last token. So one token for each
prefix is enough: the last one. Left to right, an automaton over all pieces gives the pieces that
end at a position; of these, the one is stored that is compatible with the token stored where it
begins. Two neighbours are compatible if merging their joined characters gives back just these two.
Ids are then read off the table from the end backwards. Both steps are linear in the text's length.

Pieces never continue past the start of a run of spaces, if the vocabulary allows that cut (checked
when it is loaded); then a text is encoded run by run, and a bounded memo keeps the ids of runs
that come back. Characters outside the vocabulary become their UTF-8 bytes' pieces.

Defined cases. Null text: encoded as the empty text (the end id only). Empty text: the end id only.
Very long texts: whole, in memory linear in their length. Repeated rows: each for itself. Empty
table: no rows. Extra columns stay; one with the name of an added column is replaced by it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import arrow_map, columns_of, without

SPACE = "▁"
#: Runs and pairs that a worker remembers; past this old ones give way, so memory stays bounded.
RUNS_KEPT, PAIRS_KEPT = 200_000, 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of a merge-type SentencePiece model and its prefix-table encoder."""

    def __init__(self, model: str):
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        n = vocabulary.get_piece_size()
        names = [vocabulary.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = vocabulary.eos_id(), vocabulary.unk_id()
        self.ids = {p: i for i, p in enumerate(names) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i))}
        self.scores = {p: vocabulary.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if vocabulary.is_byte(i)}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.runs_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.bytes = [b"" if vocabulary.is_control(i) else vocabulary.decode([i]).encode() if vocabulary.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for byte, i in self.byte_ids.items():
            self.bytes[i] = bytes([byte])
        self.is_byte = bytearray(n)
        for i in self.byte_ids.values():
            self.is_byte[i] = 1
        self.names = names
        self.start = n  # stands before a text's first piece
        self.pairs: dict[int, bool] = {}
        self.runs: dict[str, bytes] = {}  # ids as 32-bit numbers, without the run's first space
        self.older: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces, each with its id and length; built where texts are encoded, not where ids are decoded."""
        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        return automaton

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none can be merged."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives back just these; remembered by pair."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        names = self.names
        parts = [names[right]] if left == self.start else [names[left], names[right]]
        ok = self.pairs[left << 32 | right] = self.merged("".join(parts)) == parts
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        n = len(text)
        last, begin = [-1] * n, [0] * n  # of the prefix that ends behind each character: last piece, where it begins
        known = self.pairs.get
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            at = end - size
            left = last[at] if at >= 0 else self.start
            ok = known(left << 32 | piece)
            if ok is None:
                ok = self.compatible(left, piece)
            if ok:
                last[end], begin[end] = piece, at
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = begin[at]
        out.reverse()
        return out

    def run_ids(self, run: str) -> bytes:
        """Ids of one run, given without its first space; split where characters are outside the vocabulary."""
        known = self.runs.get(run) or self.older.get(run)
        if known is None:
            chars, text = self.chars, SPACE + run
            if chars.issuperset(text):
                out = self._known(text)
            else:
                out, start = [], 0
                for i, c in enumerate(text):
                    if c not in chars:
                        out += self._known(text[start:i])
                        out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]
                        start = i + 1
                out += self._known(text[start:])
            known = array("i", out).tobytes()
        if len(run) <= 64:
            if len(self.runs) >= RUNS_KEPT:  # runs that come back move on to the new memo, others are dropped
                self.older, self.runs = self.runs, {}
            self.runs[run] = known
        return known

    def encoded(self, text: str) -> bytes:
        """Ids of a text, the end id last, as 32-bit numbers."""
        end = array("i", [self.end]).tobytes()
        if not text:
            return end
        text = text.replace(SPACE, " ")
        if not self.runs_apart:
            return self.run_ids(text.replace(" ", SPACE)) + end
        # a run is a stretch of spaces and what follows up to the next stretch; a space stands before a text
        words = text.split(" ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            get, other = self.runs.get, self.run_ids
            return b"".join([get(w) or other(w) for w in words]) + end
        out, spaces = [], 0
        for word in words:
            spaces += 1
            if word:
                out.append(self.run_ids(SPACE * (spaces - 1) + word))
                spaces = 0
        if spaces:
            out.append(self.run_ids(SPACE * (spaces - 1)))
        return b"".join(out) + end

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: spaces restored, one leading space dropped, byte pieces read as UTF-8.

        A byte piece that is no part of a valid character becomes U+FFFD.
        """
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, None]:
                if i is not None and self.is_byte[i]:
                    run += self.bytes[i]
                    continue
                while run:
                    for width in (1, 2, 3, 4):
                        try:
                            parts.append(bytes(run[:width]).decode())
                            del run[:width]
                            break
                        except UnicodeDecodeError:
                            pass
                    else:
                        parts.append("�")
                        del run[:1]
                if i is not None:
                    parts.append(self.bytes[i].decode())
            out = "".join(parts)
        first = next((i for i in ids if self.bytes[i]), None)
        return out[1:] if first is not None and first != self.unknown and not self.is_byte[first] and out.startswith(" ") else out


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    """One encoder for each worker process, reused by all its tasks."""
    return Pieces(model)


def _added(df: DataFrame, fields: str, drop: tuple[str, ...] = ()) -> str:
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop]
    return ", ".join([*own, fields])


def _lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def encode(df: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """df without its text (unless kept) and with the text's ids as array<int>."""
    columns_of(df, text)
    model = model or default_model()
    df = without(df, ids)
    drop = () if keep_text else (text,)
    schema = _added(df, f"{ids} array<int>", drop)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model)
        at = batch.schema.get_field_index(text)
        encoded = _lists([pieces.encoded(t or "") for t in batch.column(at).to_pylist()])
        kept = [i for i in range(batch.num_columns) if keep_text or i != at]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), encoded], [*(batch.schema.names[i] for i in kept), ids])

    return arrow_map(df, work, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids. Null ids: null text."""
    columns_of(df, ids)
    model = model or default_model()
    df = without(df, text)
    schema = _added(df, f"{text} string")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model)
        column = batch.column(batch.schema.get_field_index(ids))
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        texts = [None if null else pieces.decode(values[a:b].tolist()) for a, b, null in zip(offsets[:-1], offsets[1:], nulls)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return arrow_map(df, work, schema)


def round_trip(df: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df without its text, with the text's ids and what they decode to: encode and decode in one worker, which loads the model once."""
    columns_of(df, text)
    model = model or default_model()
    df = without(df, ids, *[decoded] * (decoded != text))
    schema = _added(df, f"{ids} array<int>, {decoded} string", (text,))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model)
        at = batch.schema.get_field_index(text)
        encoded = [pieces.encoded(t or "") for t in batch.column(at).to_pylist()]
        texts = pa.array([pieces.decode(np.frombuffer(e, np.int32).tolist()) for e in encoded], pa.string())
        kept = [i for i in range(batch.num_columns) if i != at]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), _lists(encoded), texts], [*(batch.schema.names[i] for i in kept), ids, decoded])

    return arrow_map(df, work, schema)


def op2_sentencepiece(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the number and digest of ids, and the digest of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
