"""Token-ID output: one wavelet-matrix file image per shard, documents in ascending doc_id order.

Documents are range-partitioned by doc_id; every range is encoded in one streaming pass that closes a shard whenever it
holds ``shard_tokens`` ids at the end of a document.  Each shard is one file in the shared folder: the image, in the envelope
(part, shard, first id's place in the part, doc_ids) that Spark's writer gives it, so any file system that Spark can write
serves, and a lost executor only means that its ranges are encoded again.  A part's offset is the sum of the parts before it:
one number per part.

White-space separated pieces of a text are encoded independently by this tokenizer (its pattern drops white space and its
merges never cross it), and so are a stem and its final punctuation.  Texts are split in Arrow, up to ``block_bytes`` of them at
once; ids of the different stems and endings are remembered, and the library encodes those that are not.

Defined cases: null and empty texts give the end id alone; null doc_ids come first; rows that repeat a doc_id are
ordered by text and each get their own place; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, require_columns, text_bytes, worker_memory
from millrace.llm.wavelet import WaveletFile, encode

END_ID, SHARD_TOKENS = 1, 1 << 20


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that lowering keeps single letters and that no normal form takes apart or joins with ASCII punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces in one call of the library, whose answer takes some hundred bytes an id.
_AT_ONCE = 1 << 14
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: How byte-level tokenizers name the bytes that are no printable Latin-1 characters.
_BYTE_NAMES = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 324), strict=True))


def stem_lengths(pieces: pa.Array) -> np.ndarray:
    """Bytes of each piece before its final ASCII punctuation where a Latin letter stands before it: the tokenizer's pattern always cuts there.

    Elsewhere all bytes of the piece. Other letters are left to the library: lowering may end them in a mark, which is no letter.
    """
    stems = pc.ascii_rtrim(pieces, _PUNCTUATION)
    cut = pc.and_not(pc.match_substring_regex(stems, f"[{_LETTERS}]$"), pc.match_substring(pieces, "<|"))
    return pc.if_else(cut, pc.binary_length(stems), pc.binary_length(pieces)).to_numpy(zero_copy_only=False)


class PieceIds:
    """Ids of texts by a tokenizers file, with a memory of pieces; ids are kept as 16-bit or 32-bit little-endian bytes."""

    def __init__(self, tokenizer_path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.plain = Tokenizer(self.tokenizer.model)  # without normaliser and pattern
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.limit, self.memory, self.passing = limit, {b"": b""}, ()

    def _learn(self, tokenizer, pieces: list[bytes], words: list[str]) -> None:
        e = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, owners = np.array(e.ids, self.dtype), np.array(e.word_ids, np.int64)
        cuts = (np.searchsorted(owners, np.arange(len(pieces) + 1)) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        self.memory.update(zip(pieces, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Remember the ids of pieces by two kinds of calls of the library: words of small Latin letters go to its merges at once, for
        normaliser and pattern leave them as they are; the others go through the whole of it."""
        plain, words, rest = [], [], []
        for piece in pieces:
            word = piece.decode()
            if _PLAIN.fullmatch(word):
                plain.append(piece)
                words.append(word if len(word) == len(piece) else piece.decode("latin-1").translate(_BYTE_NAMES))
            else:
                rest.append(piece)
        for tokenizer, names, texts in ((self.plain, plain, words), (self.tokenizer, rest, [p.decode() for p in rest])):
            for k in range(0, len(names), _AT_ONCE):
                self._learn(tokenizer, names[k : k + _AT_ONCE], texts[k : k + _AT_ONCE])

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after the other, and where each piece's end."""
        names, stems = text_bytes(pieces), stem_lengths(pieces).tolist()
        parts = [x for p, n in zip(names, stems, strict=True) for x in (p[:n], p[n:])]  # stem and punctuation, in turn
        known = self.memory
        for part in self.passing:  # of the last call: the memory was full
            del known[part]
        self.passing = ()
        missing = set(parts).difference(known)
        self.learn(missing)
        found = list(map(known.__getitem__, parts))
        self.passing = missing if len(known) > self.limit else ()
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize)[1::2]
        return np.frombuffer(b"".join(found), self.dtype), ends

    def encode(self, texts: pa.Array | list[bytes | None]) -> list[np.ndarray]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        # the tokenizer lowers all letters itself; strings like its special tokens are left as they are
        pieces = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        offsets, different = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        del pieces
        table, ends = self._ids(different.dictionary)
        starts = np.concatenate(([0], ends))[:-1]
        codes = different.indices.to_numpy()
        counts = (ends - starts)[codes]
        upto = np.concatenate(([0], np.cumsum(counts)))
        place = np.int32 if max(upto[-1], len(table)) < 1 << 31 else np.int64
        at = np.repeat((starts[codes] - upto[:-1]).astype(place), counts)
        at += np.arange(upto[-1], dtype=place)
        ids = table.take(at)
        return np.split(ids, upto[offsets[1:-1] - offsets[0]]) if len(texts) else []


def _write(tokenizer_path: str, end_id: int, shard_tokens: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part = worker_memory(("pieces", tokenizer_path), lambda: PieceIds(tokenizer_path)), TaskContext.get().partitionId()
        held, ids, first, shard = [], [], 0, 0
        size = 0
        end = np.array([end_id], pieces.dtype)

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            image = encode(np.concatenate(held), ends)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (shard, pa.int32()), (first, pa.int64()), (int(ends[-1]), pa.int64()), (ids, pa.list_(pa.int64())), (image, pa.binary()))], ["part", "shard", "first", "n_ids", "doc_ids", "image"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            texts = texts if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.cast(pa.string())
            upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(texts):
                stop = 1 + max(at, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block_bytes, side="right")) - 1)
                for name, got in zip(names[at:stop], pieces.encode(texts[at:stop]), strict=True):
                    held.append(np.concatenate((got, end)))
                    ids.append(name)
                    size += len(held[-1])
                    if size >= shard_tokens:
                        yield close()
                        first, shard, size, held, ids = first + size, shard + 1, 0, [], []
                at = stop
        if held:
            yield close()

    return run


_FILES = "part int, shard int, first long, n_ids long, doc_ids array<long>, image binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, parts: int | None = None, block_bytes: int = 1 << 24) -> DataFrame:
    """The table of shard files of ``docs`` (doc_id, text), written to the shared folder."""
    docs = require_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = parts or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(laid.mapInArrow(_write(tokenizer_path, end_id, shard_tokens, block_bytes), _FILES), "tokens", maxRecordsPerFile=1, compression="none", **{"parquet.enable.dictionary": "false"})


def _read(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = WaveletFile(row["image"])
                ids = file.decode().astype("<u4", copy=False)
                ends = file.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = row["base"] + row["first"]
                rank = file.rank(end_id, np.concatenate(([0], ends)))  # by the bit planes, not by the decoded ids
                last = base + file.select(end_id, rank[1:] - 1)
                columns = (row["doc_ids"], base + starts, ends - starts, crc, np.diff(rank), last)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids", "end_at"])

    return run


def read_token_files(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files; n_end_ids and end_at (how often the end id
    occurs in it, and the place of the last time) by rank and select on the files."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one number per part
    base, bases = 0, []
    for part, n in sorted(totals):
        bases.append((part, base))
        base += n
    lookup = files.sparkSession.createDataFrame(bases or [(0, 0)], "part int, base long")
    return files.join(F.broadcast(lookup), "part").mapInArrow(_read(end_id), "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long, end_at long")
