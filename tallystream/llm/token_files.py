"""Operator 13: token ids in files of directly addressable codes.

An id is split into chunks of `CHUNK_BITS` bits, lowest first. Level 1 holds the first chunk of every id, level 2 the second
chunks of those ids that need one, and so on. A bitmap per level says which of its ids continue, and a rank directory counts the
ones before every `RANK_BITS`-th bit. The id at position i is found by following i through the levels: its place
in the next level is the rank of its bit in this one. No block is decoded, and a reader fetches only the bytes that it needs.

File format, little-endian (fixed values):

    magic        8 bytes, "TOKDAC01"
    header       5 unsigned 64-bit: documents, ids, chunk bits, levels, bits per rank entry
    level sizes  an unsigned 64-bit per level: ids that reach it
    doc ids      a signed 64-bit per document
    flags        a byte per document: 1 if it has an id
    starts       an unsigned 64-bit per document and one more: position of its first token in this file
    per level    chunks, a byte each; bitmap, 64-bit words; directory, an unsigned 64-bit per RANK_BITS bits

Documents are written in ascending doc_id order (null first, then by a hash of the text), over files in ascending order. Each partition of
a range sort writes files of about `FILE_TOKENS` ids, by a new name that is renamed at the end, so a task that runs twice
leaves no half file; the manifest of finished files is what readers follow.

Defined results: a null or empty text has the end id only; repeated rows and repeated ids are documents of their own; an
empty table gives no file and no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystream.llm.shared import scratch_root, staged
from tallystream.llm.word_ids import HIDDEN, WordIds, cut_words, parts

MAGIC = b"TOKDAC01"
CHUNK_BITS = 8
RANK_BITS = 512
FILE_TOKENS = 1 << 21
TEXTS_AT_ONCE = 1 << 23  # bytes of text tokenized at a time
WORDS_A_LINE = 400
KEPT_WORDS = 300_000  # and as many stems; one worker a task has the room
STOPS = ".,;:!?"
MODEL = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 2
_HEAD = 48
# white space that could join a line feed beside it
_SPACE = re.compile(f"[\\s{HIDDEN}]")
_ODD = re.compile(f"[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000{HIDDEN}]|  | \n| $")

MANIFEST = "part int, seq int, path string, documents long, tokens long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- codes ----------------------------------------------------------------------------------

def _bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of a bitmap and the ones before every RANK_BITS-th bit."""
    padded = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, bool)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view("<u8")
    ones = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
    return words, np.concatenate(([0], np.cumsum(ones, dtype=np.uint64)[:-1])).astype("<u8") if len(ones) else ones.astype("<u8")


def code_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, directory) of each level."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest >> np.uint64(CHUNK_BITS)
        levels.append(((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), *_bitmap(more > 0)))
        rest = more[more > 0]
        if not len(rest):
            return levels


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file."""
    levels = code_levels(ids)
    starts = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
    head = np.array([len(doc_ids), len(ids), CHUNK_BITS, len(levels), RANK_BITS, *[len(c) for c, _, _ in levels]], "<u8")
    out = [
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), starts.tobytes()]
    for chunks, words, directory in levels:
        out += [chunks.tobytes(), words.tobytes(), directory.tobytes()]
    return out


class TokenFile:
    """Random access to the ids of a file, by ranges of bytes; `whole` fetches the file at once, for readers of all of it."""

    def __init__(self, path: str, whole: bool = False):
        system, plain = _open(path)
        self._file = system.open_input_file(plain)
        if whole:
            with self._file as file:
                self._file = pa.BufferReader(file.read_buffer())
        head = self._read(0, _HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a file of token codes")
        self.documents, self.tokens, self._bits, n_levels, self._rank_bits = np.frombuffer(head[8:], "<u8").tolist()
        sizes = np.frombuffer(self._read(_HEAD, 8 * n_levels), "<u8").tolist()
        self._ids_at = _HEAD + 8 * n_levels
        self._flags_at = self._ids_at + 8 * self.documents
        self._starts_at = self._flags_at + self.documents
        at, self._levels = self._starts_at + 8 * (self.documents + 1), []
        for size in sizes:
            entries = -(-size // self._rank_bits)
            words_at = at + size
            ranks_at = words_at + entries * self._rank_bits // 8
            self._levels.append((at, words_at, ranks_at, size))
            at = ranks_at + 8 * entries

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def _read(self, at: int, size: int) -> bytes:
        return self._file.read_at(size, at)

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._read(self._ids_at, 8 * self.documents), "<i8").tolist()
        flags = self._read(self._flags_at, self.documents)
        return [d if f else None for d, f in zip(ids, flags)]

    def starts(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the first tokens of documents first..last, and where `last` ends."""
        last = self.documents - 1 if last is None else last
        return np.frombuffer(self._read(self._starts_at + 8 * first, 8 * (last - first + 2)), "<u8").astype(np.int64)

    def tokens_between(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1. What continues is one run of the next level, too, which begins at the rank of bit a."""
        if not 0 <= a <= b <= self.tokens:
            raise IndexError(f"{a}:{b} of {self.tokens} ids")
        out, own = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (chunks_at, words_at, ranks_at, _) in enumerate(self._levels):
            if a == b:
                break
            out[own] |= np.frombuffer(self._read(chunks_at + a, b - a), np.uint8).astype(np.uint32) << np.uint32(level * self._bits)
            entry = a // self._rank_bits
            before = int.from_bytes(self._read(ranks_at + 8 * entry, 8), "little")
            low = entry * self._rank_bits
            raw = self._read(words_at + low // 8, (b - 1) // 8 - low // 8 + 1)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: b - low].astype(bool)
            more = bits[a - low:]
            a = before + int(bits[: a - low].sum())
            own = own[more]
            b = a + len(own)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens_between(i, i + 1)[0])

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document of the file."""
        a, b = self.starts(n, n).tolist()
        return self.tokens_between(a, b)


# ---- writing --------------------------------------------------------------------------------

class _Writer:
    """Collects documents of one partition and writes a file whenever `FILE_TOKENS` ids are there."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.seq = folder, part, 0
        self.doc_ids, self.counts, self.ids, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= FILE_TOKENS:
            yield self.close()

    def close(self) -> dict:
        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        name = f"tokens-{self.part:06d}-{self.seq:06d}"
        temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            for part in file_bytes(self.doc_ids, np.array(self.counts), np.concatenate(self.ids)):
                out.write(part)
        system.move(temporary, f"{folder}/{name}.dac")
        row = {"part": self.part, "seq": self.seq, "path": f"{self.folder}/{name}.dac", "documents": len(self.doc_ids), "tokens": self.size}
        self.doc_ids, self.counts, self.ids, self.size = [], [], [], 0
        self.seq += 1
        return row


class TextIds:
    """Ids of texts by the tokenizer. It never joins what a single blank between visible characters parts, so distinct words are enough."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words = WordIds(self.solve, cut_words, "", " ", KEPT_WORDS)
        self.stems: dict[str, bytes] = {}
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of words. A line feed between visible characters is a token of its own, so words are cut there, too."""
        broken = {w: w.split("\n") for w in words if "\n" in w}
        broken = {w: x for w, x in broken.items() if all(x) and not any(_SPACE.search(y, i == 0 and y[0] == " " and len(y) > 1) for i, y in enumerate(x))}
        whole = [w for w in words if w not in broken]
        lines = list({y for x in broken.values() for y in x})
        found = self._solve(whole + lines)
        ids = dict(zip(lines, found[len(whole):]))
        feed = np.array([self.line_feed], "<i4").tobytes()
        rest = iter(found)
        return [feed.join([ids[y] for y in broken[w]]) if w in broken else next(rest) for w in words]

    def _solve(self, words: list[str]) -> list[bytes]:
        """A word and the stops after it never share a token, so stems are solved once for all their endings, in lines."""
        stems = [w.rstrip(STOPS) for w in words]
        for i in [i for i, (x, w) in enumerate(zip(stems, words)) if len(x) < len(w) and not (x[-1:].isalpha() and x[-1] < "\u2000")]:
            stems[i] = words[i]
        ends = [w[len(x):] for x, w in zip(stems, words)]
        known = self.stems
        new = [w for w in set(stems).union(ends) if w not in known]
        plain = [w for w in new if w and "\n" not in w]
        alone = [w for w in new if "\n" in w]
        lines = [self._line(plain[i: i + WORDS_A_LINE], alone) for i in range(0, len(plain), WORDS_A_LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<i4")
            cuts = np.flatnonzero(ids == self.line_feed)
            if len(cuts) != len(line) - 1:
                alone += line
                continue
            raw = ids.tobytes()
            known.update(zip(line, map(raw.__getitem__, map(slice, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]))))
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<i4").tobytes()
        known[""] = b""
        out = [known[x] + known[y] for x, y in zip(stems, ends)]
        if len(known) > KEPT_WORDS:
            self.stems = {}
        return out

    def _line(self, words: list[str], alone: list[str]) -> list[str]:
        """The words that can stand between line feeds; those with white space that could join one go to `alone`."""
        if not _ODD.search("\n".join(words)):
            return words
        odd = {w for w in words if _SPACE.search(w, 1) or w.isspace()}
        alone += odd
        return [w for w in words if w not in odd]


_tools: dict[str, TextIds] = {}


def _tool(path: str) -> TextIds:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    if path not in _tools:
        _tools[path] = TextIds(path)
    return _tools[path]


def write_tokens(
    docs: DataFrame, folder: str, row_id: str = "doc_id", text: str = "text", model: str = MODEL, end_id: int = END_ID,
) -> DataFrame:
    """Writes the files below `folder` and returns the manifest: part, seq, path, documents, tokens, start.

    `start` is the number of ids in all files before. The table of totals has a row for each file; it is summed
    by partition first, so no task sees more than the partitions or one partition's files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids, out, rows = _tool(model), _Writer(folder, TaskContext.get().partitionId()), []
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("id").to_pylist()
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in parts(size, TEXTS_AT_ONCE):
                ids, counts = text_ids.words.encode(texts.slice(a, b - a))
                last = np.cumsum(counts)
                ids = np.insert(ids, last, end_id)  # after each document
                for doc_id, x in zip(doc_ids[a:b], np.split(ids, last[:-1] + np.arange(1, len(last)))):
                    rows += out.add(doc_id, x)
        if out.size:
            rows.append(out.close())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    # rows that share an id are spread by their text, equal rows by where they were read
    order = [F.asc_nulls_first("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("id", "text", order[1].alias("mark"), order[2].alias("place"))
    placed = keyed.repartitionByRange(order[0], "mark", "place").sortWithinPartitions(order[0], "mark", "place")
    files = staged(placed.select("id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    totals = files.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(totals, "part").select(
        "part", "seq", "path", "documents", "tokens",
        (F.col("_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"))


# ---- reading --------------------------------------------------------------------------------

def read_summaries(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. A task holds one file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with TokenFile(row["path"], whole=True) as file:
                    starts = file.starts()
                    ids = memoryview(file.tokens_between(0, file.tokens).astype("<u4").tobytes())
                    ends = (4 * starts).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                    yield pa.record_batch({
                        "doc_id": pa.array(file.doc_ids(), pa.int64()), "start": pa.array(starts[:-1] + row["start"]),
                        "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64())})

    # a fixed number, because files are small rows: their sizes tell adaptive execution nothing
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds `ids` to `ranges` (first, last: positions in the whole sequence, last exclusive), fetched by position from the files.

    A range may go over several files; each file's part is fetched where the file is read and joined in order.
    """
    spans = ranges.select("first", "last").distinct()
    files = manifest.select("path", "start", (F.col("start") + F.col("tokens")).alias("end"))
    # a range meets the files by cells of FILE_TOKENS positions, so this is an equality join
    cell = lambda p: F.floor(p / FILE_TOKENS)
    left = spans.where("last > first").withColumn("_cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last") - 1))))
    right = files.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    pairs = left.join(right, "_cell").where((F.col("first") < F.col("end")) & (F.col("last") > F.col("start"))).select(
        "first", "last", "path", "start", "end").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with TokenFile(r["path"]) as file:
                    a, b = max(r["first"], r["start"]), min(r["last"], r["end"])
                    r["ids"] = file.tokens_between(a - r["start"], b - r["start"]).tolist()
            yield pa.RecordBatch.from_pylist(
                [{k: r[k] for k in ("first", "last", "start", "ids")} for r in rows],
                pa.schema([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    parts = pairs.repartition("path").mapInArrow(read, "first long, last long, start long, ids array<long>")
    whole = parts.groupBy("first", "last").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("_parts"))
    fetched = whole.select("first", "last", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))
    return ranges.join(fetched, ["first", "last"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))


def new_folder(docs: DataFrame) -> str:
    """A folder for files that are read by this application only."""
    return f"{scratch_root(docs.sparkSession)}/tallystream/tokens-{uuid.uuid4().hex}"
