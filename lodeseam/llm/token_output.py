"""Token ids as binary shards: frequency-ranked ids in byte-aligned variable-length coding.

Three steps.  (1) Texts are encoded in Arrow batches with the tokenizers library and put down as compressed rows, with
each task's token counts as rows beside them.  (2) Ids are ranked by their frequency over the whole corpus, so the
most frequent 256 take one byte; a rank is a bounded table of the vocabulary's size.  (3) Ranks are coded with two
bits of length each in control bytes (four to a byte) apart from one to four data bytes each, dealt out by ranges of
doc_id, sorted, and each partition streams its rows to a shard file under a temporary name that it then renames: a
task that runs twice writes the same bytes.

A shard file (little-endian): magic and shard number; blocks of about STEP_TOKENS tokens, each with its numbers of
documents, control bytes and data bytes, the doc_ids (their nulls as a byte each), tokens a document, bytes of control
and of data a document, control bytes, data bytes; at the end -1, documents and tokens of the file.  `decode` reads the
ranks of a block at once: a table of 256 rows gives the lengths of the four numbers of each control byte, and a gather
of the data bytes at the summed offsets gives the numbers.

Defined results: a null text is the empty text, a document is ended by the end id in any case; rows with a null doc_id
come first, equal doc_ids in the order of a hash of the text, and rows of one doc_id can lie in several shards; an empty
table gives no shard; other columns don't matter.
"""

from __future__ import annotations

import gc
import json
import operator
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm._shared import new_path, remove, small_batches
from lodeseam.llm._text import plain, ranges, split, starts, steps

MAGIC = b"LSTOKv1\n"
#: Coded bytes that a shard has about, shards at most (they are longer beyond), rows that their edges are found from: so
#: many, and so many a shard.
SHARD_BYTES, MOST_SHARDS, SAMPLE, SAMPLE_PER_SHARD = 16_000_000, 1 << 16, 10_000, 20
#: Text bytes encoded at once, tokens of a block about, coded bytes added to a block at once, and words remembered.
STEP_TEXT, STEP_TOKENS, STEP_CODED, REMEMBERED = 4_000_000, 1_000_000, 4_000_000, 800_000

# --- coding ---------------------------------------------------------------------------------------------------------

#: Of each control byte: the lengths of its four numbers, and all of them.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and how many of each every document (of `counts` numbers) has."""
    numbers = numbers.astype("<u4")
    lengths = 1 + (numbers > 0xFF).astype(np.int64) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    # Documents begin on a control byte of their own.
    n_control = -(-counts // 4)
    slots = np.zeros(int(n_control.sum()) * 4, np.uint8)
    at = ranges(4 * starts(n_control)[:-1], counts)
    slots[at] = lengths - 1
    quads = slots.reshape(-1, 4)
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8)
    keep = np.arange(4) < lengths[:, None]
    data = numbers.view(np.uint8).reshape(-1, 4)[keep]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    cuts = starts(counts)
    return control, data, n_control, ends[cuts[1:]] - ends[cuts[:-1]]


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all documents, by table lookup of the control bytes."""
    n_control = -(-counts // 4)
    at = ranges(4 * starts(n_control)[:-1], counts)
    lengths = _LENGTHS[control].ravel()[at]
    ends = np.cumsum(lengths)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    begin = ends - lengths
    words = padded[begin].astype(np.uint32)
    for k in (1, 2, 3):
        words |= padded[begin + k].astype(np.uint32) << np.uint32(8 * k)
    return words & _MASKS[lengths]


# --- tokenizing -----------------------------------------------------------------------------------------------------


#: Words of Latin letters, with ASCII punctuation (no apostrophe) behind or none; any other word, up to the line's end.
_SIMPLE = re.compile(r"^(?:([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.M)
#: Characters that stand for UTF-8 bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_ID = operator.attrgetter("id")


def by_words(settings: dict) -> bool:
    """Whether a tokenizer with these settings gives a text the ids of its words between white space, one after another.

    It does where white space is dropped and letters are apart from punctuation: lower case, letters in one piece,
    then bytes, then merges.
    """
    kinds = lambda x: [k["type"] for k in x.get("normalizers", x.get("pretokenizers", []))] if x else []
    parts = settings["pre_tokenizer"] or {}
    return (
        kinds(settings["normalizer"]) == ["NFC", "Replace", "Lowercase"]
        and kinds(parts) == ["Split", "ByteLevel"]
        and "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in parts["pretokenizers"][0]["pattern"].get("Regex", "")
        and parts["pretokenizers"][0]["invert"]
        and parts["pretokenizers"][0]["behavior"] == "Removed"
        and not (parts["pretokenizers"][1]["use_regex"] or parts["pretokenizers"][1]["add_prefix_space"])
        and settings["model"]["type"] == "BPE"
        and not settings["model"]["dropout"]
    )


class Encoder:
    """Ids of texts by the tokenizers library.

    Where `by_words` holds, each distinct word is encoded once and remembered, up to REMEMBERED words: a word of letters
    is one piece for the library's model, which is then called without the steps before it, and punctuation behind it
    another; any other word takes the whole way.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path) as f:
            self.by_word = by_words(json.load(f))
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        #: Of each word its number, and where the ids of each number end; punctuation by itself.
        self.known, self.flat, self.ends, self.tails = {}, array("I"), array("q", [0]), {"": array("I")}

    def _whole(self, text: str) -> array:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _add(self, word: str, ids: array | list[int]) -> None:
        self.known[word] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words that aren't known."""
        known, flat, ends, tails, tokenize, rest = self.known, self.flat, self.ends, self.tails, self.model.tokenize, []
        for (stem, tail, other), word in zip(_SIMPLE.findall("\n".join(words)), words, strict=True):
            if other:
                rest.append(word)
                continue
            if (at := known.get(stem)) is None:
                letters = stem.lower()
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_BYTE_LEVEL)
                flat.extend(map(_ID, tokenize(letters)))
                known[stem] = at = len(ends) - 1
                ends.append(len(flat))
            if tail:
                if (more := tails.get(tail)) is None:
                    tails[tail] = more = self._whole(tail)
                flat.extend(flat[ends[at] : ends[at + 1]] + more)
                known[word] = len(ends) - 1
                ends.append(len(flat))
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            coded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = array("I", coded.ids)
            cuts = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            for word, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                self._add(word, ids[a:b])

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each has."""
        text = plain(text)
        if not self.by_word:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(text.to_pylist(), add_special_tokens=False)]
            return np.array([i for c in coded for i in c], np.uint32), np.array([len(c) for c in coded], np.int64)
        marked = pc.any(pc.match_substring(text, "<|")).as_py()
        if not marked:  # else a string that isn't special could become so
            text = pc.ascii_lower(text)
        words, counts = split(text)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self._forget()
        gc.disable()  # many small objects that aren't cycles
        try:
            self._learn([w for w in own if w not in self.known])
        finally:
            gc.enable()
        number = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        ends = np.frombuffer(self.ends, np.int64)
        flat, begins, lengths = np.frombuffer(self.flat, np.uint32), ends[number], np.diff(ends)[number]
        # A special token's string counts as such wherever it stands, so words with one are encoded as texts.
        special = [k for k, w in enumerate(own) if any(s in w for s in self.special)] if marked else []
        if special:
            more = [self._whole(own[k]) for k in special]
            lengths[special] = [len(m) for m in more]
            begins[special] = len(flat) + starts(lengths[special])[:-1]
            flat = np.concatenate([flat, *more])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[codes]
        total = np.concatenate(([0], np.cumsum(n)))[starts(counts)]
        return flat[ranges(begins[codes], n)], np.diff(total)


_ENCODERS: dict[str, Encoder] = {}


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of documents (doc_id, tie, n, ids) and, for each task, of counts (seen, times)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ENCODERS.get(tokenizer) or Encoder(tokenizer)
        _ENCODERS[tokenizer] = own
        times = np.zeros(0, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["doc_id", "tie", "n", "ids", "seen", "times"]
        for batch in batches:
            for step in steps(batch, "text", STEP_TEXT):
                ids, n = own.ids(step.column("text"))
                ends = np.cumsum(n)
                whole = np.insert(ids, ends, end_id).astype("<u4")
                counted = np.bincount(whole)
                times = np.pad(times, (0, max(0, len(counted) - len(times))))
                times[: len(counted)] += counted
                small = whole.astype("<u2") if not len(whole) or whole.max() < 65536 else whole
                cuts = small.itemsize * starts(n + 1)
                if cuts[-1] >= 2**31:
                    raise ValueError("a text has over two billion bytes of ids")
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(small.tobytes())])
                none = [pa.nulls(len(n), k) for k in kinds[4:]]
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("tie"), pa.array(n + 1), blobs, *none], names)
        seen = np.flatnonzero(times)
        lists = [pa.array([seen.tolist()], kinds[4]), pa.array([times[seen].tolist()], kinds[5])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), *lists], names)

    schema = "doc_id long, tie long, n long, ids binary, seen array<int>, times array<long>"
    return docs.select("doc_id", "text", "tie").mapInArrow(of, schema)


def _numbers(blobs: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all rows, each with two or four bytes an id."""
    lengths = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = blobs.buffers()
    if not len(n) or data is None:
        return np.zeros(0, np.uint32)
    first = int(np.frombuffer(offsets, np.int32, 1, 4 * blobs.offset)[0])
    for kind in (np.uint16, np.uint32):
        if np.array_equal(lengths, n * kind().itemsize):
            return np.frombuffer(data, kind, int(n.sum()), first)
    wide = (lengths == 4 * n).tolist()
    return np.concatenate([np.frombuffer(b, "<u4" if w else "<u2").astype(np.uint32) for b, w in zip(blobs.to_pylist(), wide, strict=True)])


# --- files ----------------------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class ShardWriter:
    """A shard file that grows block by block, under a temporary name till it is whole."""

    def __init__(self, path: str, number: int):
        self.fs, root = _open(path)
        self.name, self.number, self.docs, self.tokens = f"{root}/shard-{number:06d}.tok", number, 0, 0
        self.part = f"{self.name}.{os.getpid()}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC + np.array([number], "<i8").tobytes())

    def add(self, doc_ids: pa.Array, counts: np.ndarray, sizes: np.ndarray, control: bytes, data: bytes) -> None:
        """A block; sizes: control and data bytes of each document."""
        nulls = pc.is_null(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        head = np.array([len(counts), len(control), len(data)], "<i8").tobytes()
        self.out.write(b"".join((head, ids.astype("<i8").tobytes(), nulls.tobytes(), counts.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), control, data)))
        self.docs, self.tokens = self.docs + len(counts), self.tokens + int(counts.sum())

    def close(self) -> pa.RecordBatch:
        self.out.write(np.array([-1, self.docs, self.tokens], "<i8").tobytes())
        self.out.close()
        self.fs.move(self.part, self.name)
        return pa.record_batch([pa.array([self.number], pa.int32()), pa.array([self.tokens])], ["shard", "tokens"])


def read_shard(path: str, number: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ranks) of each block of a shard file."""
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/shard-{number:06d}.tok") as f:

        def take(n: int) -> bytes:
            if len(data := f.read(n)) != n:
                raise ValueError("a token shard is cut short")
            return data

        if take(len(MAGIC)) != MAGIC or int.from_bytes(take(8), "little") != number:
            raise ValueError("not this token shard")
        docs = tokens = 0
        while True:
            n, n_control, n_data = np.frombuffer(take(24), "<i8").tolist()
            if n < 0:
                if (docs, tokens) != (n_control, n_data):
                    raise ValueError("a token shard lacks blocks")
                return
            ids, nulls, counts = np.frombuffer(take(8 * n), "<i8"), np.frombuffer(take(n), np.uint8), np.frombuffer(take(8 * n), "<i8")
            take(16 * n)  # a document's places, for those who want one alone
            control, data = np.frombuffer(take(n_control), np.uint8), np.frombuffer(take(n_data), np.uint8)
            docs, tokens = docs + n, tokens + int(counts.sum())
            yield pa.array(ids, mask=nulls.astype(bool)), counts, decode(control, data, counts)


def _edges(coded: DataFrame, rows: int, n_shards: int) -> np.ndarray:
    """Upper edges of the shards but the last, as rows (has an id, doc_id, tie, at), from a bounded sample of the rows.

    Only the shards' sizes hang on the sample: about equal numbers of tokens.
    """
    if n_shards < 2:
        return np.zeros((0, 4), np.int64)
    keys = coded.select(F.col("doc_id").isNotNull().cast("long"), F.coalesce("doc_id", F.lit(0)), "tie", "at", "n")
    most = max(SAMPLE, SAMPLE_PER_SHARD * n_shards)
    some = (keys.sample(most / rows, seed=1) if rows > most else keys).toPandas().to_numpy(np.int64)
    some = some[np.lexsort(some.T[3::-1])]
    ends = np.cumsum(some[:, 4])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, n_shards) / n_shards) if len(some) else []
    return np.unique(some[at, :4], axis=0)


def _shard_of(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each key the number of edges below it."""
    both = np.concatenate((edges, keys))
    order = np.lexsort((np.arange(len(both)) < len(edges), *both.T[::-1]))  # a key equal to an edge is before it
    below = np.empty(len(both), np.int64)
    below[order] = np.cumsum(order < len(edges))
    return below[len(edges) :]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shard: int = SHARD_BYTES) -> None:
    """Encodes docs and writes `path`: shard files, in ascending order of doc_id, and vocabulary.json (the rank table)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    # Numbered as they are written, so that equal rows can go to different shards and a task that runs twice agrees.
    rows = _tokenized(own, tokenizer, end_id).withColumn("at", F.monotonically_increasing_id())
    rows.write.parquet(put_down := new_path(spark, "tokens"), compression="zstd")
    rows = spark.read.schema(rows.schema).parquet(put_down)
    counts = rows.filter("seen IS NOT NULL").select(F.inline(F.arrays_zip("seen", "times"))).groupBy("seen").agg(F.sum("times").alias("times"))
    found = [(r["times"], r["seen"]) for r in counts.collect()]  # a row an id of the vocabulary
    by_rank = np.array([i for _, i in sorted(found, key=lambda x: (-x[0], x[1]))], np.uint32)
    coded = rows.filter("ids IS NOT NULL").select("doc_id", "tie", "at", "n", "ids")
    total = coded.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    edges = _edges(coded, total["rows"], min(MOST_SHARDS, max(1, -(-int(1.6 * (total["n"] or 0)) // shard))))
    names = ["doc_id", "tie", "at", "n", "shard", "control", "data"]
    shared = spark.sparkContext.broadcast((by_rank, edges))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, edges = shared.value
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        for batch in batches:
            for step in steps(batch, "ids"):
                n = step.column("n").to_numpy(zero_copy_only=False)
                control, data, a, b = encode(rank[_numbers(step.column("ids"), n)], n)
                blobs = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(starts(c).astype(np.int32)), pa.py_buffer(x.tobytes())]) for c, x in ((a, control), (b, data))]
                doc_id, tie, at = (step.column(k) for k in names[:3])
                known = pc.is_valid(doc_id).to_numpy(zero_copy_only=False).astype(np.int64)
                key = (known, *(pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (doc_id, tie, at)))
                to = pa.array(_shard_of(np.stack(key, 1), edges), pa.int32())
                yield pa.RecordBatch.from_arrays([doc_id, tie, at, step.column("n"), to, *blobs], names)

    schema = "doc_id long, tie long, at long, n long, shard int, control binary, data binary"
    dealt = coded.mapInArrow(code, schema).repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "at")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = None, [], 0

        def flush() -> None:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                column = lambda n: rows.column(n).combine_chunks()
                sizes = np.stack([pc.binary_length(column(n)).to_numpy(zero_copy_only=False) for n in ("control", "data")], 1)
                body = [b"".join(column(n).to_pylist()) for n in ("control", "data")]
                out.add(column("doc_id"), column("n").to_numpy(zero_copy_only=False), sizes, *body)
                held.clear()

        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if out is None or out.number != shards[lo]:
                    flush()
                    if out:
                        yield out.close()
                    out, size = ShardWriter(path, int(shards[lo])), 0
                for part in steps(batch.slice(lo, hi - lo), "data", STEP_CODED):
                    held.append(part)
                    size += pc.sum(part.column("n")).as_py()
                    if size >= STEP_TOKENS:
                        flush()
                        size = 0
        if out:
            flush()
            yield out.close()

    done = {r["shard"]: r["tokens"] for r in dealt.mapInArrow(put, "shard int, tokens long").collect()}  # at most MOST_SHARDS
    firsts, n = {}, 0
    for k in sorted(done):
        firsts[k], n = n, n + done[k]
    with fs.open_output_stream(f"{root}/vocabulary.json") as out:
        out.write(json.dumps({"ids_by_rank": by_rank.tolist(), "end_id": end_id, "first": firsts, "tokens": n}).encode())
    remove(spark, put_down)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/vocabulary.json") as f:
        meta = json.loads(f.read())
    shared = spark.sparkContext.broadcast((np.array(meta["ids_by_rank"], np.uint32), {int(k): v for k, v in meta["first"].items()}))
    numbers = spark.range(max(shared.value[1], default=-1) + 1, numPartitions=max(1, len(shared.value[1])))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, firsts = shared.value
        for number in (n for b in batches for n in b.column(0).to_pylist() if n in firsts):
            first = firsts[number]
            for doc_ids, counts, ranks in read_shard(path, number):
                at = starts(counts)
                ids = by_rank[ranks].astype("<u4")
                blobs = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * at), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch(
                    [doc_ids, pa.array(first + at[:-1]), pa.array(counts), blobs.cast(pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                first += int(at[-1])

    return numbers.mapInArrow(of, "doc_id long, start long, n_tokens long, ids binary")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what `read` gives."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
