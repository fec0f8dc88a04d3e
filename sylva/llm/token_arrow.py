"""Token ids as Arrow IPC files of equal-length sequences.

Documents are range-partitioned by id and encoded; ids run on from document to document, each
closed by the end id, and are cut into sequences of ``seq_len``.  A file holds record batches of
equally many fixed-size-list rows, so sequence i is row i % rows of batch i // rows, read from a
memory map without a copy.  Columns: ``tokens`` (16-bit ids where the vocabulary allows, else 32),
``mask`` (bits: false where the last sequence of a file is filled up), and the ids and places of
the documents that begin in a sequence.  A file is written under an attempt's name and renamed, so
a lost executor's task leaves no half file and a second attempt gives the same bytes.

Encoding splits a text before each space that follows a character which is not white space, and new
pieces between a letter and a mark; byte-level pre-tokenizers of this kind never span such a place,
so ids of the pieces are the ids of the text (special tokens hold no space and are never cut).
Words are encoded by the library once and remembered by the worker, up to ``remembered`` of them.

Scale.  One exchange by document id, no other; a task holds a batch of texts and one record batch.
The driver holds one row a file (start and counts); adding these up gives global starts.

Edge cases: null and empty texts are the end id alone; null doc_ids come first; repeated rows are
encoded as often as they come, in any order among themselves; an empty table gives no file and an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"
_TWO_BLANKS = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_SPLIT = "\ue000"  # parts words for a moment; texts that hold it go the plain way
_ODD = "[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] |\\x{e000}"  # as _TWO_BLANKS, or _SPLIT
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARK = '.,;:!?"*$%&#'
#: Inside a piece: between a letter and a mark or line end, and after a line end between a letter or mark and a letter.
_FINER = re.compile(rf"(?<=[{_LETTER}])(?=[{_MARK}\n])|(?<=[{_LETTER}{_MARK}]\n)(?=[{_LETTER}])")
_AFTER_LETTER = rf"([A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}])([{_MARK}\n])"
_AFTER_LINE = rf"([{_MARK}]\n)([A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}])"


def chunks(text: str) -> list[str]:
    """The text cut at each blank that follows a character other than white space; that blank goes
    with the piece behind it, all pieces but the first having lost theirs."""
    return _CUT.split(text) if _TWO_BLANKS.search(text) else text.split(" ")


class Encoder:
    """ids of whole texts as little-endian bytes of ``width``.

    A text's ids are the ids of its words in order; words are encoded once and remembered.
    """

    def __init__(self, tokenizer: str, remembered: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(tokenizer), remembered
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Have the library encode the words that are not known yet."""
        if len(self.words) > self.remembered:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            said = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(said.word_ids, np.int64), minlength=len(some))) * self.width.itemsize if len(said) else np.zeros(len(some), np.int64)
            data, last = np.array(said.ids, self.width).tobytes(), 0
            for w, end in zip(some, ends.tolist()):
                self.words[w] = data[last:end]
                last = end

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Texts one by one, with pieces cut by Python's patterns."""
        parts = []
        for t in texts:
            pieces = chunks(t) if t else []
            pieces = pieces[:1] + [" " + c for c in pieces[1:]]
            parts.append([w for c in pieces if c for w in ([c] if c.isspace() or any(x in c for x in self.special) else _FINER.split(c))])
        self._learn(list({w for p in parts for w in p}))
        return [b"".join(map(self.words.__getitem__, p)) for p in parts]

    def column(self, texts: pa.Array) -> list[bytes]:
        """As a call, with the cutting and the look-up of repeated pieces and words done by Arrow: Python
        sees each distinct word of the column once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        rare, plain = np.flatnonzero(odd), np.flatnonzero(~odd)
        for i, ids in zip(rare, self([texts[int(i)].as_py() for i in rare])):
            out[i] = ids
        if not len(plain):
            return out
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        ends = parts.offsets.to_numpy()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        # distinct pieces with the blank before them; a text's first piece has none
        pieces = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())), flat.take(pa.array(ends[:-1].astype(np.int64)))])
        at = coded.indices.to_numpy().astype(np.int64)
        at[ends[:-1]] = len(coded.dictionary) + np.arange(len(parts))
        cut = pc.replace_substring_regex(pc.replace_substring_regex(pieces, _AFTER_LETTER, rf"\1{_SPLIT}\2"), _AFTER_LINE, rf"\1{_SPLIT}\2")
        for x in self.special:
            cut = pc.if_else(pc.match_substring(pieces, x), pieces, cut)
        words = pc.split_pattern(cut, _SPLIT)
        word_ends, own = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        distinct = own.dictionary.to_pylist()
        self._learn(distinct)
        ids = list(map(self.words.__getitem__, distinct))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        of_piece, bounds = _gathered(np.frombuffer(b"".join(ids), self.width), np.concatenate(([0], np.cumsum(size))), own.indices.to_numpy().astype(np.int64))
        every, bounds = _gathered(of_piece, bounds[word_ends], at)
        bounds = bounds[ends]
        for i, a, b in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = every[a:b].tobytes()
        return out


def _gathered(values: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs begin[i]:begin[i + 1] of values for each i in which, one after the other; where each begins, with the end)."""
    count = (begin[1:] - begin[:-1])[which]
    upto = np.concatenate(([0], np.cumsum(count)))
    return values[np.repeat(begin[which] - upto[:-1], count) + np.arange(upto[-1])], upto


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder: what it remembers serves its later tasks too."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def layout(width: np.dtype, seq_len: int) -> pa.Schema:
    kind = pa.uint16() if width.itemsize == 2 else pa.uint32()
    return pa.schema([("tokens", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len)), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32()))])


class Writer:
    """Cuts a stream of documents into sequences and writes them in equal batches."""

    def __init__(self, sink, width: np.dtype, seq_len: int, rows: int):
        self.schema = layout(width, seq_len).with_metadata({"seq_len": str(seq_len), "rows": str(rows)})
        self.file, self.width, self.seq_len, self.rows = pa.ipc.new_file(sink, self.schema), width, seq_len, rows
        self.held, self.size, self.begun, self.n_docs, self.n_tokens, self.n_sequences = [], 0, [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.begun.append((self.size, doc_id))
        self.held.append(ids)
        n = len(ids) // self.width.itemsize
        self.size += n
        self.n_docs += 1
        self.n_tokens += n
        if self.size >= self.rows * self.seq_len:
            self._flush(self.size // (self.rows * self.seq_len) * self.rows)

    def _flush(self, sequences: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.width)
        for a in range(0, sequences, self.rows):
            n = min(self.rows, sequences - a)
            lo, hi = a * self.seq_len, (a + n) * self.seq_len
            own = ids[lo:hi]
            mask = np.arange(lo, hi) < len(ids)
            if len(own) < hi - lo:
                own = np.concatenate((own, np.zeros(hi - lo - len(own), self.width)))
            here = [(x - lo, d) for x, d in self.begun if lo <= x < hi]
            count = np.bincount([x // self.seq_len for x, _ in here], minlength=n)
            ends = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(own), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len), pa.ListArray.from_arrays(ends, pa.array([d for _, d in here], pa.int64())), pa.ListArray.from_arrays(ends, pa.array([x % self.seq_len for x, _ in here], pa.int32()))]
            self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.n_sequences += n
        done = sequences * self.seq_len
        self.begun = [(x - done, d) for x, d in self.begun if x >= done]
        self.held = [ids[done:].tobytes()]
        self.size = max(0, len(ids) - done)

    def close(self) -> None:
        if self.size:
            self._flush(-(-self.size // self.seq_len))
        self.file.close()


class Sequences:
    """Random access to a file: rows are views of the mapped file."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.seq_len, self.rows = (int(self.file.schema.metadata[k]) for k in (b"seq_len", b"rows"))

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        lo = row * self.seq_len
        return (batch.column("tokens").values.slice(lo, self.seq_len).to_numpy(), batch.column("mask").values.slice(lo, self.seq_len).to_numpy(zero_copy_only=False))

    def documents(self):
        """(doc_id or None, ids) of each document, in order, a batch at a time."""
        doc, held, open_ = None, [], False
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids = batch.column("tokens").values.to_numpy()[: int(np.count_nonzero(batch.column("mask").values.to_numpy(zero_copy_only=False)))]
            ends, at = batch.column("doc_ids").offsets.to_numpy(), batch.column("doc_starts").values.to_numpy()
            at = at + np.repeat(np.arange(batch.num_rows) * self.seq_len, np.diff(ends))
            last = 0
            for x, d in zip(at.tolist(), batch.column("doc_ids").values.to_pylist()):
                if open_:
                    held.append(ids[last:x])
                    yield doc, np.concatenate(held)
                doc, held, open_, last = d, [], True, x
            held.append(np.array(ids[last:]))
        if open_:
            yield doc, np.concatenate(held)


def write(documents: DataFrame, tokenizer: str, folder: str | None = None, seq_len: int = 2048, rows: int = 64, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest (part, path, n_docs, n_tokens, n_sequences, start)."""
    spark = documents.sparkSession
    folder = folder or _store.work_dir(spark, "tokens")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        task, writer = TaskContext.get(), None
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        part = task.partitionId()
        final, own = f"{base}/part-{part:06d}.arrow", f"{base}/.part-{part:06d}-{task.taskAttemptId()}"
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.width).tobytes()
        for batch in batches:
            for some in _text.pieces(batch, "text", 8 << 20):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(own)
                    writer = Writer(sink, encode.width, seq_len, rows)
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode.column(some.column("text"))):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [final], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]})

    ordered = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    files = sorted(ordered.mapInArrow(run, MANIFEST).collect())  # a row a file
    start, out = 0, []
    for f in files:
        out.append((*f, start))
        start += f.n_tokens
    return spark.createDataFrame(out, f"{MANIFEST}, start long")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                out = [[], [], [], []]
                with fs.open_input_file(path) as source:
                    for doc_id, ids in Sequences(source).documents():
                        for column, x in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")))):
                            column.append(x)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n).select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files and describe every document from what they hold."""
    folder = options.pop("folder", None) or _store.work_dir(documents.sparkSession, "tokens")
    return read_documents(write(documents, tokenizer, folder, **options), folder)
