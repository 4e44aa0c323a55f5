"""Token ids in seekable files: one zstandard frame for each document.

A file is a sequence of independent zstandard frames, one for each document in
ascending id order, then three skippable frames: a JSON header (id width, end
id), the document ids, and the seek table of the published seekable format
(compressed size, size and checksum of every frame, then a nine-byte footer).
Any zstandard decoder reads the ids; a reader that knows the table opens only the
frames it wants and checks each against its checksum.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodia.llm.words import text_parts
from episodia.session import fresh_folder, written

# fixed values of the seekable format
SKIPPABLE_HEADER, SKIPPABLE_IDS, SKIPPABLE_TABLE = 0x184D2A50, 0x184D2A51, 0x184D2A5E
FOOTER_MAGIC, CHECKSUM_FLAG = 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")

#: a file is closed at so many documents or ids, so its table stays small
FILE_DOCS, FILE_IDS = 200_000, 1 << 27
LEVEL = 3
READ_BYTES = 4 << 20

#: a full stop or comma that ends a word after a Latin-1 letter or digit is a piece of its own
LONE_MARK = re.compile(rb".*[a-z\xdf-\xf6\xf8-\xff0-9][.,]", re.DOTALL)
LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def open_store(folder: str):
    """File system and path below it of a folder named by path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Pieces(dict):
    """Row number of each word; new ones are put down in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class Encoder:
    """Ids of texts; each distinct word is encoded by the library once.

    The vocabulary's rules drop white space and never join across it, so the ids
    of a text are those of its words one after another.  In Latin-1 texts lower
    case and composition act letter by letter, so there words are first put into
    lower case, and a word with a lone mark at its end has the ids of both parts.  The
    caches are emptied between batches when they hold more than ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.limit = limit
        self.caches = {}
        self.reset()

    def reset(self) -> None:
        # key bytes differ by encoding, so each has its own cache
        none = np.empty(0, np.int64)
        self.caches = {code: (Pieces(), np.empty(0, np.uint32), none, none) for code in ("latin-1", "utf-8")}

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case Latin-1 letters alone.

        Such a word is one piece and its last id carries the end-of-word mark, so
        many words go to the library as one text and are told apart afterwards.
        """
        flat, _ = self._library([" ".join(words[i:i + 500]) for i in range(0, len(words), 500)])
        last = np.flatnonzero(self.ends_word[flat]) if len(flat) else np.empty(0, np.int64)
        if len(last) != len(words):
            return self._library(words)
        return flat, np.diff(last, prepend=-1)

    def _learn(self, code: str) -> None:
        """Append the ids of new words; a row of the cache is a place in them and a length."""
        rows, flat, starts, lens = self.caches[code]
        if not rows.fresh:
            return
        old = len(starts)
        marked = [(rows[w], rows[w[:-1]], rows[w[-1:]]) for w in tuple(rows.fresh) if code == "latin-1" and LONE_MARK.fullmatch(w)]
        whole, stem, mark = (np.array(x, np.int64) for x in (zip(*marked) if marked else ((), (), ())))
        starts, lens = (np.concatenate([x, np.zeros(len(rows.fresh), np.int64)]) for x in (starts, lens))
        alone = np.ones(len(rows.fresh), bool)
        alone[whole - old] = False
        words = [w.decode(code, "replace") if a else "" for w, a in zip(rows.fresh, alone)]
        plain = np.fromiter((code == "latin-1" and LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        size, new = len(flat), [flat]
        for some, encode in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain & alone), self._library)):
            ids, n = encode([words[i] for i in some])
            starts[old + some], lens[old + some] = size + np.cumsum(n) - n, n
            size += len(ids)
            new.append(ids)
        flat = np.concatenate(new)
        n = lens[stem] + lens[mark]
        starts[whole], lens[whole] = size + np.cumsum(n) - n, n
        both = np.stack([stem, mark], 1).ravel()
        flat = np.concatenate([flat, self._gathered(flat, starts[both], lens[both])])
        self.caches[code] = rows, flat, starts, lens
        rows.fresh = []

    @staticmethod
    def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Runs of ``flat`` one after another."""
        ends = np.cumsum(lens)
        return flat[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if sum(len(rows) for rows, *_ in self.caches.values()) > self.limit:
            self.reset()
        found = {code: ([], []) for code in self.caches}
        for i, t in enumerate(texts):
            code, words = "utf-8", []
            if t:
                try:
                    # special tokens are found in their own case only
                    if b"<|" in t:
                        raise UnicodeError
                    words = t.decode("utf-8").lower().encode("latin-1").split()
                    code = "latin-1"
                except UnicodeError:
                    words = t.split()
            places, row = found[code]
            places.append(i)
            row.append(np.fromiter(map(self.caches[code][0].__getitem__, words), np.int64, len(words)))
        out = [np.empty(0, np.uint32)] * len(texts)
        for code, (places, row) in found.items():
            if not places:
                continue
            self._learn(code)
            _, flat, starts, lens = self.caches[code]
            every = np.concatenate(row)
            ids, upto = self._gathered(flat, starts[every], lens[every]), np.concatenate([[0], np.cumsum(lens[every])])
            edges = upto[np.concatenate([[0], np.cumsum([len(r) for r in row])])]
            for i, begin, end in zip(places, edges, edges[1:]):
                out[i] = ids[begin:end]
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a worker, which meet mostly the same words."""
    return Encoder(vocabulary)


def skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class FrameWriter:
    """One file under construction; it gets its name only when it is complete."""

    def __init__(self, store, path: str, width: str, end_id: int):
        import zstandard

        self.store, self.path, self.width, self.end_id = store, path, width, end_id
        self.out = store.open_output_stream(path + ".open")
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.table, self.ids, self.n_ids = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(self.width).tobytes()
        frame = self.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.n_ids += len(ids)

    def close(self) -> tuple:
        self.out.write(skippable(SKIPPABLE_HEADER, json.dumps({"width": self.width, "end": self.end_id}).encode()))
        values = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        self.out.write(skippable(SKIPPABLE_IDS, values + bytes(i is not None for i in self.ids)))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(skippable(SKIPPABLE_TABLE, entries + FOOTER.pack(len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)))
        self.out.close()
        self.store.move(self.path + ".open", self.path)
        return self.path, len(self.table), self.n_ids


def read_frames(store, path: str, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, ids before it in the file, its ids), for all or the wanted ids.

    Only the frames asked for are read and decompressed; a frame that does not
    fit its checksum raises.
    """
    import xxhash
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    with store.open_input_file(path) as f:
        size = f.size()
        n, _, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        at = size - FOOTER.size - 12 * n
        table = np.frombuffer(f.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        at -= 8 + 9 * n
        ids = f.read_at(9 * n, at)
        doc_ids, valid = np.frombuffer(ids[:8 * n], "<i8"), np.frombuffer(ids[8 * n:], np.uint8)
        place = np.concatenate([[0], np.cumsum(table[:, 0])])
        head = f.read_at(at - 8 - int(place[-1]), int(place[-1]))
        header = json.loads(head[8:8 + struct.unpack("<II", head[:8])[1]])
        width = np.dtype(header["width"])
        before = np.concatenate([[0], np.cumsum(table[:, 1])]) // width.itemsize
        names = [int(i) if v else None for i, v in zip(doc_ids, valid)]
        take = [i for i in range(n) if wanted is None or names[i] in wanted]
        k = 0
        while k < len(take):
            first = last = take[k]
            while k + 1 < len(take) and take[k + 1] == last + 1 and place[last + 2] - place[first] <= READ_BYTES:
                k, last = k + 1, last + 1
            data = f.read_at(int(place[last + 1] - place[first]), int(place[first]))
            for i in range(first, last + 1):
                raw = decompress(data[place[i] - place[first]:place[i + 1] - place[first]])
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table[i, 2]:
                    raise ValueError(f"frame {i} of {path} is damaged")
                yield names[i], int(before[i]), np.frombuffer(raw, width)
            k += 1


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id`` long, ``text``) below ``folder``; one row for each file.

    Documents are range-partitioned by id; rows with one id are spread by text
    and row.  A task writes under a name of its own attempt and renames the
    file when it is complete; only files of successful tasks are in the result
    (``part``, ``seq``, ``path``, ``docs``, ``ids``, ``start``), so a lost executor
    leaves at most an unlisted file.  ``start`` counts the ids of all files before.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        tokens, context, writer, seq, done = encoder(vocabulary), TaskContext.get(), None, 0, []
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in text_parts(whole):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text").to_pylist())):
                    if writer is None:
                        writer = FrameWriter(store, f"{base}/ids-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.zst", tokens.width, end_id)
                    writer.add(doc_id, np.concatenate([ids, end]))
                    if len(writer.table) >= FILE_DOCS or writer.n_ids >= FILE_IDS:
                        done.append((context.partitionId(), seq, *writer.close()))
                        writer, seq = None, seq + 1
        if writer is not None:
            done.append((context.partitionId(), seq, *writer.close()))
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("part", "seq", "path", "docs", "ids"))},
                                         schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_u")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_u": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = written(rows.mapInArrow(run, "part long, seq long, path string, docs long, ids long"), "files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return written(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "manifest")


def read_token_files(files: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``).

    With ``wanted``, a list of document ids, only their frames are decompressed.
    """
    chosen = None if wanted is None else set(wanted)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for doc_id, before, ids in read_frames(store, path, chosen):
                    rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] * with_ids)))
                    held += len(ids) if with_ids else 1
                    if held >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.select("path", "start").repartition(parts, "path").mapInArrow(run, schema)


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all ``docs`` and read them back, one row for each document.

    Null and empty texts are the end id alone.  Rows with one id follow each
    other; null ids come first.  Columns other than ``doc_id`` and ``text`` are
    ignored; an empty table gives an empty one.
    """
    folder = fresh_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, folder, end_id), folder)


def op9_seekable_frames(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
