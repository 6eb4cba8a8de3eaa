"""Token ids of documents in files of canonical, length-limited Huffman code.

1. Documents are dealt out in ranges of doc_id, sorted, tokenised once and kept as ids (with the end id).
2. Ids are counted over all documents in the same pass; code lengths of at most ``limit`` bits come from the package-merge method, codes are
   canonical, so the lengths describe them.
3. Each range is written in files of independent blocks: about ``BLOCK_IDS`` ids, the documents' numbers and lengths, the
   bit offset of every ``STEP``-th id, and the bits. A file starts with the code lengths, so it can be read alone.
4. Blocks are decoded by a table of all ``limit``-bit words; the stretches between checkpoints are decoded side by side.

Counts (one row a token id) and code lengths are bounded by the vocabulary. Ids before a file are summed over the list of
files. Documents with one doc_id follow each other by text; a null doc_id comes first; null texts are empty. No documents
give no files. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.files import NewFile, read_random
from feedlake.session import cut_lineage, run_folder

BLOCK_IDS, STEP, FILE_BYTES = 500_000, 256, 128_000_000
MAGIC = b"HUFIDS01"
#: Bytes of words that a Python worker remembers with their ids; a limit on memory only.
REMEMBERED = 32_000_000
#: Bytes of text that are cut and encoded at once; a limit on memory only.
CALL_BYTES = 6_000_000
STOPS = ".,;:!?"


class Known:
    """Words that a worker has met, their ids one behind the other, and the number of ids of each."""

    def __init__(self, kind: np.dtype):
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.empty(0, kind), np.empty(0, np.int64)


_KNOWN: dict[int, Known] = {}


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian bytes of ``width``.

    The library cuts a byte-level text before each single space that stands between two characters other than white space,
    and encodes the parts alone. So each chunk between such spaces is given to it once, many in one text, and remembered; the
    ids that begin with a space tell where a chunk begins. Texts with other white space around spaces, or with a special
    token, go to it whole.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if self.vocabulary <= 65536 else "<u4")
        self.spaced = np.zeros(self.vocabulary, bool)
        # The byte-level alphabet writes a space as U+0120.
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.stops = np.frombuffer(b"".join(self.whole(list(STOPS))), self.type)
        assert len(self.stops) == len(STOPS)
        self.known = _KNOWN.setdefault(zlib.crc32(json_text.encode()), Known(self.type))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words with a space in front, one behind the other, and the number of ids of each; -1 where a tokenizer
        does not cut at spaces, so that texts with this word are encoded whole."""
        n = len(words)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(np.arange(0, n, 256), n), pa.int64()), words)
        texts, found, sizes = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist(), [], np.full(n, -1)
        for k in range(0, len(texts), 64):
            encoded = self.tokenizer.encode_batch_fast([" " + t for t in texts[k:k + 64]], add_special_tokens=False)
            for j, e in enumerate(encoded, k):
                ids = np.array(e.ids, self.type)
                each = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
                if len(each) == min(256, n - 256 * j):
                    sizes[256 * j:256 * j + 256] = each
                    found.append(ids)
        return np.concatenate([np.empty(0, self.type), *found]), sizes

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct ``words`` begin and how many they are."""
        known = self.known
        place = pc.fill_null(pc.index_in(words, value_set=known.words), -1).to_numpy().astype(np.int64)
        new = place < 0
        fresh = words.filter(pa.array(new))
        ids, sizes = self.learn(fresh)
        place[new] = len(known.words) + np.arange(len(fresh))
        ids, sizes = np.concatenate([known.ids, ids]), np.concatenate([known.sizes, sizes])
        # What comes first is what comes often.
        if known.words.nbytes < REMEMBERED:
            known.words, known.ids, known.sizes = pa.concat_arrays([known.words, fresh]), ids, sizes
        begins = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        return ids, begins[place], sizes[place]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` behind it, and the number of ids of each.

        Arrow cuts the texts and numbers their distinct chunks. A stop behind a letter is a part of its own, so it is taken off
        its word. The first chunk of a text has no space in front and is encoded as it is.
        """
        if not len(texts):
            return np.empty(0, self.type), np.empty(0, np.int64)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        at, chunks = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary
        first, later = at[starts], np.ones(len(at), bool)
        later[starts] = False
        words = pc.replace_substring_regex(chunks, r"(\pL)[.,;:!?]$", r"\1")
        stop = pc.index_in(pc.utf8_slice_codeunits(chunks, -1), value_set=pa.array(list(STOPS), pa.large_string()))
        stop = np.where(pc.not_equal(words, chunks).to_numpy(zero_copy_only=False), pc.fill_null(stop, -1).to_numpy(), -1)
        words = words.dictionary_encode()
        word = words.indices.to_numpy().astype(np.int64)
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(words.dictionary), words.dictionary), pc.not_equal(words.dictionary, "")).to_numpy(zero_copy_only=False)
        met = np.zeros(len(plain), bool)
        met[word[at[later]]] = True
        met &= plain
        begin, size = np.zeros(len(plain), np.int64), np.full(len(plain), -1)
        ids, begin[met], size[met] = self.word_ids(words.dictionary.filter(pa.array(met)))
        begin, size = begin[word][at], size[word][at]
        # Texts that are encoded whole: nothing to cut, a chunk that can't be encoded alone, or a special token.
        n_chunks = np.diff(np.append(starts, len(at)))
        whole = (n_chunks < 2) | (np.add.reduceat((size < 0) & later, starts) > 0) | ~plain[word[first]]
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        own = np.array(pa.array(first).take(pa.array(np.flatnonzero(~whole))))
        own, back = np.unique(own, return_inverse=True)
        alone = self.whole(chunks.take(pa.array(own)).to_pylist() + texts.filter(pa.array(whole)).to_pylist())
        lengths = np.array([len(e) for e in alone], np.int64) // self.type.itemsize
        places = len(ids) + np.cumsum(lengths) - lengths
        entry = np.empty(len(starts), np.int64)
        entry[~whole], entry[whole] = back, len(own) + np.arange(whole.sum())
        size[np.repeat(whole, n_chunks)] = 0
        begin[starts], size[starts] = places[entry], lengths[entry]
        # Stops behind their words and ends behind their texts are entries of one id.
        stop = np.where(np.repeat(whole, n_chunks) | ~later, -1, stop[at])
        n_ids = np.add.reduceat(size + (stop >= 0), starts) + 1
        ids = np.concatenate([ids, np.frombuffer(b"".join(alone), self.type), self.stops, np.array([end], self.type)])
        stopped, ends = np.flatnonzero(stop >= 0), np.append(starts[1:], len(at))
        behind = np.append(stopped + 1, ends)
        begin = np.insert(begin, behind, np.append(len(ids) - 1 - len(STOPS) + stop[stopped], np.full(len(ends), len(ids) - 1)))
        size = np.insert(size, behind, 1)
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], n_ids


def package_merge(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most ``limit`` bits; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    if len(used) > 2**limit:
        raise ValueError(f"{len(used)} ids need words longer than {limit} bits")
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(weights))
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        top = int(size.max())
        codes[order] = np.cumsum(np.r_[0, 2 ** (top - size[:-1])]) >> (top - size)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """The bits of ``ids``, the bit offset of every ``STEP``-th id, and the number of bits."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        where = at >> 5
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        both = np.bitwise_or.reduceat(wide, first)
        words[where[first]] |= both >> np.uint64(32)
        words[where[first] + 1] |= both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), at[::STEP].astype("<u8"), total


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for every word of as many bits as the longest code."""
    top = max(1, int(lengths.max(initial=1)))
    codes = canonical(lengths).astype(np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    run = 1 << (top - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    begin = codes[used] << (top - lengths[used].astype(np.int64))
    at = np.repeat(begin, run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    ids[at], size[at] = np.repeat(used, run), np.repeat(lengths[used], run)
    return ids, size, top


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table) -> np.ndarray:
    ids, size, top = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
    words = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    out = np.zeros((len(checkpoints), STEP), np.uint32)
    at = checkpoints.astype(np.int64)
    mask = np.uint64((1 << top) - 1)
    for k in range(STEP):
        at = np.minimum(at, (len(words) - 1) * 8)
        word = (words[at >> 3] >> (40 - top - (at & 7)).astype(np.uint64)) & mask
        out[:, k] = ids[word]
        at += size[word]
    return out.ravel()[:n]


BLOCKS = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()),
                    ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
BLOCKS_DDL = "path string, part int, seq long, offset long, bytes long, before long, n_ids long, n_docs long"


def block_bytes(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, codes, lengths) -> bytes:
    """Header (documents, ids, bits), null flags and numbers of documents, their lengths, checkpoints, bits."""
    bits, checkpoints, total = pack(ids, codes, lengths)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((struct.pack("<QQQ", len(doc_ids), len(ids), total), known.tobytes(), numbers.tobytes(),
                     sizes.astype("<u4").tobytes(), checkpoints.tobytes(), bits))


def read_block(data: bytes, table):
    """doc_ids, sizes and ids of a block."""
    docs, n, total = struct.unpack_from("<QQQ", data)
    at = 24
    parts = []
    for count, kind in ((docs, "u1"), (docs, "<i8"), (docs, "<u4"), (-(-n // STEP), "<u8")):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    known, numbers, sizes, checkpoints = parts
    ids = unpack(data[at:], checkpoints, n, table) if n else np.empty(0, np.uint32)
    return [int(d) if k else None for d, k in zip(numbers, known)], sizes, ids


def header(lengths: np.ndarray) -> bytes:
    packed = zlib.compress(lengths.tobytes())
    return MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed


def read_header(file) -> np.ndarray:
    if file.read_at(8, 0) != MAGIC:
        raise ValueError("not a file of token ids")
    vocabulary, size = struct.unpack("<II", file.read_at(8, 8))
    lengths = np.frombuffer(zlib.decompress(file.read_at(size, 16)), np.uint8)
    assert len(lengths) == vocabulary
    return lengths


TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                    ("counts", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))])
TOKENS_DDL = "doc_id long, part int, seq long, n long, ids binary, counts array<struct<id: int, n: long>>"


def by_bytes(batch: pa.RecordBatch):
    """A batch in slices of about ``CALL_BYTES`` of text, one text at least."""
    sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
    groups = (np.cumsum(sizes) - sizes) // CALL_BYTES
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield batch.slice(begin, end - begin)


def tokenise(docs: DataFrame, json_text: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id, part, seq, n and ids (bytes), sorted by doc_id through the parts; written to the shared folder. A further row of
    each task, without a part, has the counts of its ids."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, seq, part, total = Encoder(json_text), 0, TaskContext.get().partitionId(), np.zeros(vocabulary, np.int64)
        size = encoder.type.itemsize
        for batch in batches:
            for b in by_bytes(batch):
                ids, n = encoder.encode(b.column("text"), end_id)
                total += np.bincount(ids, minlength=vocabulary)
                offsets = pa.py_buffer(np.append(0, np.cumsum(n) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))), pa.array(n),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids)]), pa.nulls(len(n), TOKENS.field("counts").type)],
                    schema=TOKENS)
                seq += len(n)
        used = np.flatnonzero(total)
        counts = pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(TOKENS)[:-1]), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), counts)],
                                         schema=TOKENS)

    path = run_folder(spark, "ids")
    rows.mapInArrow(run, TOKENS_DDL).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TOKENS_DDL).parquet(path)


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents: the sum of the tasks' counts."""
    counts = np.zeros(vocabulary, np.int64)
    each = tokens.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    for row in each.collect():
        counts[row["id"]] = row["n"]
    return counts


def write(docs: DataFrame, json_text: str, end_id: int) -> DataFrame:
    """Encode and write ``docs``; returns one row a block: path, offset, bytes, start (ids before it), n_ids, n_docs."""
    folder = run_folder(docs.sparkSession, "token-ids")
    encoder = Encoder(json_text)
    vocabulary, kind = max(encoder.vocabulary, end_id + 1), encoder.type
    tokens = tokenise(docs, json_text, end_id, vocabulary)
    counts = id_counts(tokens, vocabulary)
    limit = max(16, int(np.count_nonzero(counts)).bit_length() + 1)
    lengths = package_merge(counts, limit)
    codes = canonical(lengths)

    def run(batches):
        file, held, place, next_place, before = None, [], None, None, 0

        def flush():
            nonlocal held, before
            ids = np.frombuffer(b"".join(x[1] for x in held), kind)
            sizes = np.array([len(x[1]) // kind.itemsize for x in held])
            data = block_bytes([x[0] for x in held], sizes, ids, codes, lengths)
            row = (file.uri, *place, file.size, len(data), before, len(ids), len(held))
            file.write(data)
            before += len(ids)
            held = []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for doc_id, part, seq, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "seq", "n", "ids"))):
                if file is not None and ((part, seq) != next_place or file.size >= FILE_BYTES):
                    if held:
                        yield flush()
                    file.close()
                    file = None
                if file is None:
                    file, before, total = NewFile(folder, ".hufids"), 0, 0
                    file.write(header(lengths))
                if not held:
                    place, total = (part, seq), 0
                held.append((doc_id, ids))
                total += n
                next_place = (part, seq + 1)
                if total >= BLOCK_IDS:
                    yield flush()
        if file is not None:
            if held:
                yield flush()
            file.close()

    blocks = cut_lineage(tokens.where("part is not null").drop("counts").mapInArrow(run, BLOCKS_DDL))
    # One row a file: those of 128 MB make a million of 100 TB.
    files = blocks.groupBy("path").agg(F.min(F.struct("part", "seq")).alias("place"), F.sum("n_ids").alias("ids"))
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("file_start"))
    return blocks.join(starts, "path").select("path", "offset", "bytes", (F.col("file_start") + F.col("before")).alias("start"), "n_ids", "n_docs")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files block by block."""
    def run(batches):
        tables: dict[bytes, tuple] = {}
        for batch in batches:
            for path, offset, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "bytes", "start"))):
                with read_random(path) as file:
                    lengths = read_header(file)
                    key = lengths.tobytes()
                    if key not in tables:
                        tables.clear()
                        tables[key] = decode_table(lengths)
                    doc_ids, sizes, ids = read_block(file.read_at(size, offset), tables[key])
                ends = np.cumsum(sizes.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
