"""Operator 1: token ids in independent Zstandard frames with a seek table and a document index.

Each shard holds the documents of one range of ids in ascending order. A frame
holds the ids (little-endian unsigned 32-bit) of as many whole documents as
reach ``frame_bytes``; the index (an Arrow table in a skippable frame) says for
each document its frame and place, so ``read_documents`` decompresses only the
frames it needs. Frames are checked on every read.

A special token's string in a text is that token, as the library has it unless
told otherwise; with ``special_as_text`` it is text like any other.

Defined results: a null text is empty and gives the end id alone; a null id
sorts first; rows repeated under one id are each written; other columns are
ignored; an empty table gives no shard and no row. Shard files have a name of
their own for each attempt and only those named in the manifest are read, so a
lost executor leaves at worst an unread file.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .seekable import Reader, Writer

END_ID = 0
STEP = "token output"
FRAME_BYTES = 1 << 18
#: The longest word kept in a worker's table of encoded words.
CACHE_LENGTH = 48
#: Entries of that table, and documents whose new words are encoded together: fewer take less memory, more less time. Neither changes a result.
CACHE_WORDS, MANY_WORDS = 60_000, 600_000
BATCH_DOCS, MANY_DOCS = 250, 5000
#: Documents whose ids are laid out together.
LAYOUT_DOCS = 250

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_frames int, n_bytes long"
READ = "doc_id long, shard int, frame int, place long, n_tokens long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins what stands before a space to what follows
    when the next character is not white space: a token can only begin at that
    space. So texts are cut there, words seen before are taken from a table,
    and the new words of a batch are encoded together, in one text. The first
    token of a word is the only one that begins with a space, which tells the
    words of that text apart. The ids equal those of the whole text.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        #: Texts with an added token are encoded whole: it may stand anywhere in a word.
        self._added = re.compile("|".join(added)).search if added else lambda text: None
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._begins = np.array([(self._tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(size)])
        self._most = cache_words
        self._kept: dict[str, bytes] = {}
        self._firsts: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words (each with the space before it) into the table."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = self._ids(" " + " ".join(part))
            edges = np.append(np.flatnonzero(self._begins[ids]), len(ids)) * 4
            data = ids.tobytes()
            self._kept.update(zip(part, (data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))))

    def _first(self, text: str) -> bytes:
        """The ids of what stands before a text's first cut; common beginnings are kept too."""
        ids = self._firsts.get(text)
        if ids is None:
            ids = self._ids(text).tobytes()
            if len(text) <= CACHE_LENGTH and len(self._firsts) < self._most // 10:
                self._firsts[text] = ids
        return ids

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of words that are to be found or learned, each with the space before it."""
        out = list(map(self._kept.get, words))
        new = [w for w, ids in zip(words, out) if ids is None]
        if new:
            if len(self._kept) + len(new) > self._most:
                self._kept.clear()
            self._learn(new)
            out = [self._kept[w] if ids is None else ids for w, ids in zip(words, out)]
            for w in new:
                if len(w) > CACHE_LENGTH:
                    del self._kept[w]
        return out

    def _slow(self, text: str) -> bytes:
        first, *words = re.split(r" (?=\S)", text)
        return b"".join([self._first(first), *(self._ids(f" {w}").tobytes() for w in words)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        special = [bool(self._added(t)) for t in texts]
        slow = [s or bool(_awkward(t)) for s, t in zip(special, texts)]
        plain = [t for t, s in zip(texts, slow) if not s]
        ready = iter(self._plain(plain) if plain else [])
        return [self._ids(t).tobytes() if whole else self._slow(t) if s else next(ready) for t, whole, s in zip(texts, special, slow)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """``encode`` for texts whose spaces are all places to cut: words are numbered, looked up once and laid out."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        which, firsts = coded.indices.to_numpy().astype(np.int64), edges[:-1]
        later = np.ones(len(which), bool)
        later[firsts] = False
        needed = np.flatnonzero(np.bincount(which[later], minlength=len(coded.dictionary)))
        parts = self._looked_up(coded.dictionary.take(pa.array(needed)).to_numpy(zero_copy_only=False).tolist())
        place = np.zeros(len(coded.dictionary), np.int64)
        place[needed] = np.arange(len(needed))
        which = place[which]
        which[firsts] = len(needed) + np.arange(len(texts))
        parts += [self._first(t.split(" ", 1)[0]) for t in texts]
        pool, lengths = np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin, out = np.cumsum(lengths) - lengths, []
        for a in range(0, len(texts), LAYOUT_DOCS):
            here = edges[a : a + LAYOUT_DOCS + 1]
            some = which[here[0] : here[-1]]
            count = lengths[some]
            total = np.concatenate([[0], np.cumsum(count)])
            ids = pool[np.repeat(begin[some] - total[:-1], count) + np.arange(total[-1])]
            cuts = total[here - here[0]].tolist()
            out += [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
        return out


#: A space before white space or at the end: a place where the text may not be cut.
_awkward = re.compile(r" (?:\s|$)").search


def encoder(path: str, special_as_text: bool = False, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder for each worker, which keeps its table from task to task until another step runs there."""
    return common.kept(f"{STEP} {path} {special_as_text} {cache_words}", lambda: Encoder(path, special_as_text, cache_words))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, frame_bytes: int = FRAME_BYTES, special_as_text: bool = False, batch_docs: int = BATCH_DOCS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id, text) under ``path``; returns their manifest, itself written."""
    vocabulary = vocabulary or default_vocabulary()

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        name = f"{path}/shard-{(part := TaskContext.get().partitionId()):06d}-{uuid.uuid4().hex}.zst"
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        held: list[bytes] = []
        size = n_tokens = 0

        def encoded(texts: pa.Array) -> Iterator[bytes]:
            for at in range(0, len(texts), batch_docs):
                for data in encoder(vocabulary, special_as_text, cache_words).encode(texts[at : at + batch_docs].to_pylist()):
                    yield data + end

        ids, frames, places, counts = [], [], [], []
        for k, batch in enumerate(batches):
            if k % 8 == 7:
                common.release()
            writer = writer or Writer(name)
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                ids.append(doc_id)
                frames.append(len(writer.frames))
                places.append(size // 4)
                counts.append(len(data) // 4)
                held.append(data)
                size += len(data)
                n_tokens += len(data) // 4
                if size >= frame_bytes:
                    writer.frame(b"".join(held))
                    held, size = [], 0
        if writer is None:
            return
        if held:
            writer.frame(b"".join(held))
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "frame": pa.array(frames, pa.int32()), "place": pa.array(places, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        writer.close(sink.getvalue())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(ids)], "n_tokens": [n_tokens], "n_frames": pa.array([len(writer.frames)], pa.int32()), "n_bytes": [writer.size]})

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(rows.transform(common.in_arrow, shards, MANIFEST, f"{STEP} {vocabulary} {special_as_text} {cache_words}"), "token-manifest", batch_docs)


def _index(reader: Reader) -> pa.Table:
    return pa.ipc.open_stream(reader.index()).read_all()


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the given documents of one shard; only their frames are decompressed."""
    wanted, reader, out, frames = set(doc_ids), Reader(path), {}, {}
    for row in _index(reader).to_pylist():
        if row["doc_id"] in wanted:
            if row["frame"] not in frames:
                frames = {row["frame"]: np.frombuffer(reader.frame(row["frame"]), dtype="<u4")}
            out[row["doc_id"]] = frames[row["frame"]][row["place"] : row["place"] + row["n_tokens"]]
    reader.close()
    return out


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads back every shard: a row for each document, its place in the corpus and the checksum of its ids.

    The corpus offset is the sum of the shards before (a window over one row a
    shard) and of the documents before in the shard.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                index = _index(reader)
                frame, place, count = (index.column(c).to_numpy() for c in ("frame", "place", "n_tokens"))
                crc = np.empty(len(frame), dtype=np.int64)
                at = 0
                for k in range(len(reader.frames)):
                    data = memoryview(reader.frame(k))
                    while at < len(frame) and frame[at] == k:
                        crc[at] = zlib.crc32(data[4 * place[at] : 4 * (place[at] + count[at])])
                        at += 1
                reader.close()
                starts = row["before"] + np.concatenate([[0], np.cumsum(count)[:-1]])
                out = pa.table({"doc_id": index.column("doc_id"), "start": pa.array(starts.astype(np.int64)), "n_tokens": pa.array(count), "ids_crc32": pa.array(crc), "shard": pa.array(np.full(len(frame), row["shard"], np.int32)), "frame": pa.array(frame)})
                yield from out.to_batches(max_chunksize=10_000)

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before).select("shard", "path", "before")
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "shard").transform(common.in_arrow, read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, frame int")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, common.scratch(spark, "tokens"), batch_docs=MANY_DOCS, cache_words=MANY_WORDS)
    return read_tokens(manifest)
