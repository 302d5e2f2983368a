"""Operator 5: SentencePiece encoding and decoding with a given vocabulary of scored pieces.

Encoding is the unigram Viterbi: among all ways to cut a text into pieces the one with the largest sum of log
scores, the earliest start winning a tie. Candidates come from a double-array trie over UTF-8 bytes. A character
that is no piece costs the smallest score less `UNKNOWN_PENALTY` and is written as byte pieces. White space is
marked by U+2581 and a marker is put before the text; no piece goes across the beginning of a run of
markers, so the optimum splits there and is found once for each distinct word of a task.

Decoding joins pieces, turns markers into spaces, bytes into text, and removes the first marker. The round trip is
exact: a U+2581 in the text itself is always written as bytes.

Defined results: null gives null ids and decodes to null; an empty text has no ids; ids out of range raise an
error; repeated rows are encoded each; other columns are returned as they are, except the two result columns,
which replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallystream.llm.word_ids import WordIds, parts, ragged

MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORST = float("-inf")
LONG_WORD = 48  # characters beyond which a word is solved on its own
TOGETHER = 512  # words solved at a time
BYTES_AT_ONCE = 1 << 21  # of text encoded at a time
IDS_AT_ONCE = 1 << 18  # decoded at a time
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Texts and scores of the pieces by id, which of them match text, and the ids of the 256 byte pieces."""

    texts: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; a vocabulary is a bounded table."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts = [model.id_to_piece(i) for i in ids]
    at = {t: i for i, t in enumerate(texts)}
    usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    return Vocabulary(texts, [model.get_score(i) for i in ids], usable, [at[f"<0x{b:02X}>"] for b in range(256)])


class DoubleArrayTrie:
    """Byte trie in two arrays: the child of state s under byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = v
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        # single children fill the first free places, larger families look from a place that moves on
        state, free, look = {0: 0}, 258, 258
        for node, own in enumerate(children):  # parents come before their children
            at = state[node]
            self.value[at] = value[node]
            if not own:
                continue
            low = min(own) + 1
            while free < len(taken) and taken[free]:
                free += 1
            base = max(1, (free if len(own) == 1 else max(free, look)) - low)
            tries = 0
            while any(base + b + 1 < len(taken) and taken[base + b + 1] for b in own):
                base += 1
                tries += 1
            if tries > 64:
                look = base + low
            need = base + 258 - len(taken)
            if need > 0:
                self.base += [0] * need
                self.check += [-1] * need
                self.value += [-1] * need
                taken += bytearray(need)
            self.base[at] = base
            for b, child in own.items():
                taken[base + b + 1] = 1
                self.check[base + b + 1] = at
                state[child] = base + b + 1


class Encoder:
    """Words to ids; kept by a Python worker for all its tasks with the same vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        keys = {t.encode(): i for i, t in enumerate(vocabulary.texts) if vocabulary.usable[i]}
        self.trie = DoubleArrayTrie(keys)
        self.score = [None if v < 0 else vocabulary.scores[v] for v in self.trie.value]
        self.arrays = (
            np.array(self.trie.base, np.int32), np.array(self.trie.check, np.int32), np.array(self.trie.value, np.int32),
            np.array(vocabulary.scores))
        self.single = {k for k in keys if len(k.decode()) == 1}
        self.byte_ids = vocabulary.byte_ids
        self.unknown = min(s for s, u in zip(vocabulary.scores, vocabulary.usable) if u) - UNKNOWN_PENALTY
        self.byte_id = np.array(vocabulary.byte_ids, np.int32)
        self.words = WordIds(self.solve, _cut, MARK, MARK)

    def _viterbi(self, word: str) -> list[int]:
        if LITERAL in word:  # no piece may cover a marker of the text itself
            ids = []
            for k, part in enumerate(word.split(LITERAL)):
                ids += ([self.byte_ids[b] for b in MARK.encode()] if k else []) + (self._viterbi(part) if part else [])
            return ids
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        data = word.encode()
        n = len(data)
        best, back, piece = [WORST] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far = best[i]
            if so_far == WORST:
                continue
            state = 0
            for j in range(i, n):
                to = base[state] + data[j] + 1
                if check[to] != state:
                    break
                state = to
                total = score[to]
                if total is not None:
                    total += so_far
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, i, value[to]
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if data[i: i + width] not in self.single and so_far + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = so_far + self.unknown, i, -1
        ids = []
        at = n
        while at:
            i, v = back[at], piece[at]
            ids.extend([v] if v >= 0 else [self.byte_ids[b] for b in reversed(data[i:at])])
            at = i
        ids.reverse()
        return ids

    def _viterbi_many(self, words: list[str]) -> list[bytes]:
        """The same for many short words, as bytes: all trie walks at once, then all words' best cuts position by position,
        then all ways back at once."""
        base, check, value, score = self.arrays
        take = np.take
        raw = [w.encode() for w in words]
        n = np.array([len(x) for x in raw])
        most = int(n.max())
        data = np.frombuffer(b"".join(x.ljust(most + 1, b"\0") for x in raw), np.uint8).astype(np.int32)
        data = data.reshape(-1, most + 1)
        data[np.arange(most + 1)[None, :] >= n[:, None]] = 256  # leads nowhere
        row, start = np.nonzero((data < 256) & ((data & 0xC0) != 0x80))
        lead = data[row, start]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        flat, first = data.ravel(), row * (most + 1) + start
        single = np.zeros(len(row), bool)
        at, state, edges, depth = np.arange(len(row)), np.zeros(len(row), np.int32), [], 0
        cursor = first.copy()
        while len(at):
            to = take(base, state, mode="clip") + take(flat, cursor, mode="clip") + 1
            go = np.flatnonzero(take(check, to, mode="clip") == state)
            at, state, cursor, depth = at[go], to[go], cursor[go] + 1, depth + 1
            by = take(value, state, mode="clip")
            hit = np.flatnonzero(by >= 0)
            own, by = at[hit], by[hit]
            single[own[width[own] == depth]] = True
            edges.append((own, np.full(len(own), depth), score[by], by))
        own = np.flatnonzero(~single)
        edges.append((own, width[own], np.full(len(own), self.unknown), np.full(len(own), -1, np.int32)))
        walk, length, gain, by = (np.concatenate(x) for x in zip(*edges))
        order = np.argsort(start[walk], kind="stable")
        walk, length, gain, by = walk[order], length[order], gain[order], by[order]
        from_at = start[walk]
        source, target = first[walk], first[walk] + length
        best = np.where(np.arange(most + 1) == 0, 0.0, WORST) + np.zeros((len(raw), 1))
        best, back, piece = best.ravel(), np.zeros(best.size, np.int32), np.full(best.size, -1, np.int32)
        cuts = np.searchsorted(from_at, np.arange(most + 1))
        for i in range(most):
            part = slice(cuts[i], cuts[i + 1])
            total, to = best[source[part]] + gain[part], target[part]
            better = total > best[to]
            to = to[better]
            best[to], back[to], piece[to] = total[better], i, by[part][better]
        # all words go back from their ends together, a piece each at a time
        here, steps = np.arange(len(raw)) * (most + 1) + n, []
        word = np.arange(len(raw))
        while len(word):
            from_ = word * (most + 1) + back[here]
            steps.append((word, from_, here, piece[here]))
            go = np.flatnonzero(from_ > word * (most + 1))
            word, here = word[go], from_[go]
        word, from_, to, by = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(word, kind="stable")  # later steps stand first, so pieces are in the order of the text
        word, from_, by = word[order], from_[order], by[order]
        size = np.where(by >= 0, 1, to[order] - from_)  # unknown characters are as many byte pieces
        ids = np.where(np.repeat(by >= 0, size), np.repeat(by, size), self.byte_id[flat[ragged(from_, size)] & 255]).astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, size, len(raw)).astype(np.int64))
        return list(map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())))

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of words; short ones are solved together."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD and LITERAL not in w]
        short.sort(key=lambda i: len(words[i]))
        for a in range(0, len(short), TOGETHER):
            part = short[a: a + TOGETHER]
            for i, ids in zip(part, self._viterbi_many([words[i] for i in part])):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > LONG_WORD or LITERAL in w:
                out[i] = np.array(self._viterbi(w), "<i4").tobytes()
        return out

    def encode(self, text: str) -> list[int]:
        return self.words.encode(pa.array([text]))[0].tolist()


# a private-use stand-in would clash with itself in a text; a lone surrogate cannot occur in one
LITERAL = "\udc81"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _cut(text: str) -> list[str]:
    """Words of any text, each with the markers before it."""
    return _WORDS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for when decoded."""
    out = [t.replace(MARK, " ").encode() for t in vocabulary.texts]
    for b, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([b])
    return out


class Decoder:
    """Ids to texts, by one gather over the bytes of all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = piece_bytes(vocabulary)
        self.length = np.array([len(b) for b in self.table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)

    def decode(self, lists: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.table)):
            raise IndexError("id outside of the vocabulary")
        start, size = self.start[ids], self.length[ids]
        first = (np.cumsum(n) - n)[n > 0]
        plain = size[first] > 0
        plain[plain] = self.bytes[start[first[plain]]] < 128
        if plain.all():  # the first character, a marker in all encoded texts, is one byte
            start[first] += 1
            size[first] -= 1
            sums = np.concatenate(([0], np.cumsum(size)))
            ends = sums[np.cumsum(n)]
            data = self.bytes[ragged(start, size)]
            whole = pa.Array.from_buffers(pa.binary(), len(n), [
                None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])
            try:
                return pc.if_else(lists.is_valid(), whole.cast(pa.string()), None)
            except pa.ArrowInvalid:  # bytes that are no text
                pass
        flat, ends = ids.tolist(), np.cumsum(n).tolist()
        return pa.array([
            b"".join(map(self.table.__getitem__, flat[b - k: b])).decode("utf-8", "replace")[1:] if ok else None
            for b, k, ok in zip(ends, n.tolist(), lists.is_valid().to_pylist())], pa.string())


_workers: dict[str, dict[str, object]] = {}


def _tool(name: str, shared, make):
    """One encoder and one decoder per Python worker, of the vocabulary used last."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = {}
    tools = _workers[name]
    if make.__name__ not in tools:
        tools[make.__name__] = make(Vocabulary(*shared.value))
    return tools[make.__name__]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns))
    columns[name] = values
    return pa.record_batch(columns)


@dataclass(frozen=True)
class _Step:
    """A column made from another: by fill(values, tool)."""

    source: str
    name: str
    kind: T.DataType
    make: type
    fill: Callable


def _mapped(docs: DataFrame, vocabulary: Vocabulary, *steps: _Step) -> DataFrame:
    """`docs` with the columns of `steps`, made one after another in one Python worker, a bounded part of a batch at a time."""
    fields = (vocabulary.texts, vocabulary.scores, vocabulary.usable, vocabulary.byte_ids)
    shared = docs.sparkSession.sparkContext.broadcast(fields)
    key = hashlib.md5(repr(fields).encode()).hexdigest()
    result = docs.schema
    for step in steps:
        names = [f.name for f in result.fields]
        field = T.StructField(step.name, step.kind)
        result = T.StructType(
            [field if f.name == step.name else f for f in result.fields] if step.name in names else [*result.fields, field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(steps[0].source)
            lists = pa.types.is_list(column.type)
            length = pc.list_value_length(column) if lists else pc.binary_length(column)
            for a, b in parts(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), IDS_AT_ONCE if lists else BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                for step in steps:
                    part = _with_column(part, step.name, step.fill(part.column(step.source), _tool(key, shared, step.make)))
                yield part

    return docs.mapInArrow(run, result)


def _encode(column: pa.Array, encoder: Encoder) -> pa.Array:
    found, counts = encoder.words.encode(column)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32)), mask=column.is_null())


def _encoding(text: str, ids: str) -> _Step:
    return _Step(text, ids, T.ArrayType(T.IntegerType()), Encoder, _encode)


def _decoding(ids: str, text: str) -> _Step:
    return _Step(ids, text, T.StringType(), Decoder, lambda column, decoder: decoder.decode(column))


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the piece ids of `text`."""
    return _mapped(docs, vocabulary, _encoding(text, ids))


def decoded(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the piece ids stand for."""
    return _mapped(docs, vocabulary, _decoding(ids, text))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", again: str = "decoded") -> DataFrame:
    """Both, in one pass: the piece ids of `text`, and the text decoded from them."""
    return _mapped(docs, vocabulary, _encoding(text, ids), _decoding(ids, again))
