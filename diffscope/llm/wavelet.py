"""Token ids as wavelet matrices: one compressed, searchable file per shard.

A file holds the ids of consecutive documents as bit planes, highest bit first. In each plane the ids stand in the order
the planes above have left them in: zeros before ones, both in their old order. A plane is cut into blocks of 65,536 bits,
each compressed on its own and stored with its size and the number of ones before it. So a file answers access (id at a
position), rank and count (how often an id occurs before a position), select (place of the k-th occurrence) and lists of
occurrences by opening one block of each plane, without decoding the rest.

Documents are dealt to shards by id range (ascending, null ids last, equal ids by a hash of the text); a shard rolls to a
new file at `roll_ids` ids, so memory is bounded whatever a shard holds. Tasks write under temporary names; the driver
moves the files of finished tasks to their names and writes the manifest last. A reader trusts the manifest only.

Defined cases: null text is empty text, and every document ends with the end id, so an empty document has one id;
repeated rows are stored as often as they occur; an empty table gives a manifest without files.
"""

from __future__ import annotations

import json
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.llm.ranges import cuts, dealt, place, shard_of
from diffscope.llm.store import Files, shared_folder, written
from diffscope.llm.words import BlockHasher, Words, chunks

MAGIC = b"WAVELET2"
BLOCK = 1 << 16  # bits of a compressed block
LEVEL = 1
END_ID = 2
# What may part words in a joined call, a control character that is one id, else a special token.
MARKS = ("\x01", "\x02", "\x1e", "\x7f", "<|startoftext|>")
# The rules by which words fall into parts that are encoded on their own, in either case of their letters.
PARTED = ({"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


class Plane:
    """Bits in blocks, each compressed alone (as it is where that is no longer), and the number of ones before each."""

    def __init__(self, n: int, blocks: list, ones: np.ndarray):
        self.n, self.blocks, self.ones = n, blocks, ones
        self.codec, self.opened = pa.Codec("zstd", LEVEL), (-1, b"")

    @classmethod
    def of(cls, bit: np.ndarray) -> "Plane":
        packed, step = np.packbits(bit), BLOCK // 8
        whole = np.zeros(-(-len(packed) // step) * step, dtype=np.uint8)
        whole[:len(packed)] = packed
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.int64)
        plane = cls(len(bit), [], np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
        for low in range(0, len(packed), step):
            raw = packed[low:low + step].tobytes()
            short = plane.codec.compress(raw, asbytes=True)
            plane.blocks.append(short if len(short) < len(raw) else raw)
        return plane

    def block(self, number: int) -> np.ndarray:
        """Packed bits of a block; the last one opened is kept."""
        if self.opened[0] != number:
            size = min(BLOCK // 8, -(-self.n // 8) - number * (BLOCK // 8))
            raw = self.blocks[number]
            if len(raw) < size:
                raw = self.codec.decompress(raw, size, asbytes=True)
            self.opened = number, np.frombuffer(raw, dtype=np.uint8)
        return self.opened[1]

    def bits(self) -> np.ndarray:
        """All bits as booleans."""
        parts = [self.block(i) for i in range(len(self.blocks))]
        return np.unpackbits(np.concatenate(parts) if parts else np.zeros(0, np.uint8), count=self.n).view(bool)

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1

    def ones_before(self, i: int) -> int:
        number, rest = divmod(i, BLOCK)
        count = int(self.ones[number])
        if rest:
            part = self.block(number)[:-(-rest // 8)]
            count += int(np.bitwise_count(part).sum()) - int(part[-1] & ((1 << -rest % 8) - 1)).bit_count()
        return count

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) `bit` for ascending k."""
        before = self.ones.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        number = np.searchsorted(before, ranks, side="right") - 1
        found = np.empty(len(ranks), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(ranks)]
        for low, high in zip(edges, edges[1:]):
            if low < high:
                at = int(number[low])
                places = np.flatnonzero(np.unpackbits(self.block(at)) == bit)
                found[low:high] = at * BLOCK + places[ranks[low:high] - before[at]]
        return found


class WaveletMatrix:
    """Bit planes, highest bit first, and the number of zeros of each."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, zeros, x = [], [], ids
        for level in range(bits - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(Plane.of(bit))
            zeros.append(len(x) - int(planes[-1].ones[-1]))
            y = np.empty_like(x)
            y[zeros[-1]:] = x[bit]
            np.logical_not(bit, out=bit)
            y[:zeros[-1]] = x[bit]
            x = y
        return cls(len(ids), planes, zeros)

    def _down(self, level: int, bit: int, i: int) -> int:
        ones = self.planes[level].ones_before(i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = plane.bit(i)
            value = value << 1 | bit
            i = self._down(level, bit, i)
        return value

    def _bits(self, value: int) -> Iterator[tuple[int, int]]:
        high = len(self.planes) - 1
        for level in range(high + 1):
            yield level, value >> (high - level) & 1

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level, bit in self._bits(value):
            start, end = self._down(level, bit, start), self._down(level, bit, end)
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often `value` occurs before position i."""
        if value >> len(self.planes):
            return 0
        start, end = self._range(value, 0, i)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _places(self, value: int, ranks: np.ndarray) -> np.ndarray:
        """Positions of the occurrences of `value` with these ascending numbers."""
        at = ranks + self._range(value, 0, self.n)[0]
        for level, bit in reversed(list(self._bits(value))):
            at = self.planes[level].select(bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of `value`."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        return int(self._places(value, np.array([k], dtype=np.int64))[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of `value`, ascending."""
        count = self.count(value)
        return self._places(value, np.arange(count, dtype=np.int64)) if count else np.zeros(0, dtype=np.int64)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, dtype=kind)
        for i, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            bit = self.planes[level].bits()
            x[self.zeros[level]:] |= kind(1 << i)
            y = np.empty(self.n, dtype=kind)
            y[bit] = x[self.zeros[level]:]
            np.logical_not(bit, out=bit)
            y[bit] = x[:self.zeros[level]]
            x = y
        return x

    def to_bytes(self, doc_ids: list, counts: np.ndarray) -> Iterator[bytes]:
        """File content in parts: magic, header, documents, then each plane's block sizes, counts and blocks."""
        head = json.dumps({"n": self.n, "bits": len(self.planes), "zeros": self.zeros, "documents": len(counts)}).encode()
        valid = np.array([d is not None for d in doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
        yield from (MAGIC, len(head).to_bytes(4, "little"), head, valid.tobytes(), ids.tobytes(),
                    counts.astype("<u4").tobytes())
        for plane in self.planes:
            yield np.array([len(b) for b in plane.blocks], dtype="<u4").tobytes()
            yield plane.ones.astype("<u4").tobytes()
            yield b"".join(plane.blocks)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["WaveletMatrix", list, np.ndarray]:
        """The matrix, the document ids, and the number of ids of each document. Blocks are opened when asked for."""
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12:12 + size])
        n, docs, at = head["n"], head["documents"], 12 + size
        whole = memoryview(data)

        def take(kind, count):
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        valid, ids, counts = take(np.uint8, docs), take("<i8", docs), take("<u4", docs)
        planes, blocks = [], -(-n // BLOCK)
        for _ in range(head["bits"]):
            sizes, ones = take("<u4", blocks), take("<u4", blocks + 1)
            ends = at + np.cumsum(sizes, dtype=np.int64)
            planes.append(Plane(n, [whole[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())], ones))
            at = int(ends[-1]) if blocks else at
        return cls(n, planes, head["zeros"]), [i if v else None for i, v in zip(ids.tolist(), valid)], counts


class Encoder:
    """Ids of texts. White space parts words for this tokenizer, so each different word is encoded once per task.

    A tokenizer with the rules of `PARTED` also parts ASCII letters and digits from the signs next to them (not from an
    apostrophe, nor inside its added tokens) and reads A-Z as a-z. For it a word is such a part, known in either case; those
    of ASCII letters alone go to its model without the steps before it, which would only lower them.
    """

    def __init__(self, path: str, most_words: int = 2_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.text, self.mark = next((m, ids[0]) for m in MARKS if len(ids := self._ids(m)) == 1
                                    and self._ids(f"a {m} b") == [*self._ids("a"), *ids, *self._ids("b")])
        self.most = most_words
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parted = (rules["normalizer"], rules["pre_tokenizer"]) == PARTED and not any(t.isalnum() for t in self.added)
        self.hasher, self.exact = BlockHasher(fold=self.parted), BlockHasher()
        # by the suffix of a word's last id the words of a call are told apart; each letter must have an id with and without
        names, suffix = self.tokenizer.get_vocab(with_added_tokens=False), rules["model"].get("end_of_word_suffix")
        letters = string.ascii_lowercase
        self.letters = None
        if self.parted and suffix and all(x in names and x + suffix in names for x in letters):
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(names.values()) + 1, dtype=bool)
            self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True
        kinds = np.zeros(256, dtype=np.uint8)  # 1: letter or digit, 2: sign
        for i in range(0x21, 0x7F):
            kinds[i] = 1 if chr(i).isalnum() else 2 * (i not in b"'" + b"".join(self.added))
        self.kinds = kinds.tobytes()
        self._forget()

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if not self.parted:
            return self.exact.words(data, offsets)
        raw = data.tobytes()
        kinds = np.frombuffer(raw.translate(self.kinds), dtype=np.uint8)
        cuts = np.flatnonzero(kinds[1:] + kinds[:-1] == 3) + 1
        small = raw.lower()  # added tokens are found in their own case only
        hasher = self.exact if any(t.lower() in small for t in self.added) else self.hasher
        words = hasher.words(data, np.concatenate((offsets, cuts)))
        words.first = np.searchsorted(words.start, offsets)
        return words

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted word hashes
        self.slot = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint16)
        self.start = np.zeros(1, dtype=np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        base, order = len(self.start) - 1, np.arange(len(texts))
        flat, counts = [self.flat], []
        if self.letters:
            plain = np.array([x.isascii() and x.isalpha() for x in texts])
            order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
            texts = [texts[i] for i in order.tolist()]
            plain_texts, texts = texts[:int(plain.sum())], texts[int(plain.sum()):]
            joined = [" ".join(plain_texts[low:low + 200]).lower() for low in range(0, len(plain_texts), 200)]
            for found in self.letters.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(found.ids, dtype=np.uint16)
                counts.append(np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
                flat.append(ids)
        parts = [texts[low:low + 200] for low in range(0, len(texts), 200)]
        joined = [f" {self.text} ".join(part) for part in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, dtype=np.uint16)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(part) - 1:
                counts.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
                flat.append(ids[ids != self.mark])
            else:  # a word holds the mark itself
                alone = [self._ids(x) for x in part]
                counts.append(np.array([len(x) for x in alone], dtype=np.int64))
                flat.append(np.array([i for x in alone for i in x], dtype=np.uint16))
        slots = np.empty(len(hashes), dtype=np.int64)
        slots[order] = base + np.arange(len(hashes))
        self.flat = np.concatenate(flat)
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(counts))))
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.slot = np.insert(self.slot, place, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each text)."""
        words = self._words(data, offsets)
        different, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        near = np.minimum(np.searchsorted(self.known, different), max(0, len(self.known) - 1))
        new = self.known[near] != different if len(self.known) else np.ones(len(different), dtype=bool)
        if new.any():
            raw = data.tobytes()
            at = first[new]
            self._learn(different[new], [raw[s:e].decode() for s, e in zip(words.start[at].tolist(),
                                                                           words.end[at].tolist())])
        slots = self.slot[np.searchsorted(self.known, different)][inverse] if len(different) else np.zeros(0, dtype=np.int64)
        # each text is its words' ids, then the end id: place them in one flat array
        per_word = self.start[slots + 1] - self.start[slots]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        counts = ends[words.first[1:]] - ends[words.first[:-1]] + 1
        out = np.full(int(counts.sum()), end_id, dtype=np.uint16)
        doc = np.repeat(np.arange(len(counts)), words.counts)
        target = ends[:-1] + doc
        total = int(per_word.sum())
        within = np.arange(total) - np.repeat(ends[:-1], per_word)
        out[np.repeat(target, per_word) + within] = self.flat[np.repeat(self.start[slots], per_word) + within]
        return out, counts


def write_ids(documents: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, shard_bytes: int = 64 << 20, roll_ids: int = 1 << 25) -> None:
    """Encode `documents` and write the files and the manifest to `folder`."""
    rows = documents.select(place(id_col).alias("place"), F.col(id_col).cast("long").alias("doc_id"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    where = cuts(written(rows.select("place", F.octet_length("text").cast("long").alias("bytes")), "sizes"), shard_bytes)
    files = Files(folder)
    files.make("_temporary")

    def run(batches):
        encoder, out = Encoder(tokenizer), Files(folder)
        bits = max(1, int(max(encoder.tokenizer.get_vocab_size(), end_id + 1) - 1).bit_length())
        if bits > 16:
            raise ValueError("ids of more than 16 bits")
        shard, roll, held, docs, counts, size = None, 0, [], [], [], 0

        def close():
            name, temporary = f"ids-{shard:06d}-{roll:04d}.wm", f"_temporary/{uuid.uuid4().hex}"
            ids = np.concatenate(held)
            held.clear()
            with out.create(temporary) as f:
                for part in WaveletMatrix.build(ids, bits).to_bytes(docs, np.concatenate(counts)):
                    f.write(part)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([temporary]), pa.array([len(ids)], pa.int64()),
                                               pa.array([len(docs)], pa.int64())], ["name", "temporary", "ids", "documents"])

        for b in batches:
            shards = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if shard is not None and shards[low] != shard and size:
                    yield close()
                    held, docs, counts, size = [], [], [], 0
                if shards[low] != shard:
                    shard, roll = int(shards[low]), 0
                part = b.slice(low, high - low)
                for first, data, offsets in chunks(part.column(2)):
                    ids, n = encoder.encode(data, offsets, end_id)
                    held.append(ids)
                    counts.append(n)
                    docs += part.column(1).slice(first, len(n)).to_pylist()
                    size += len(ids)
                    if size >= roll_ids:
                        yield close()
                        held, docs, counts, size, roll = [], [], [], 0, roll + 1
        if size:
            yield close()

    sorted_rows = dealt(rows.withColumn("shard", shard_of(where, F.col("place"))).withColumn("tie", F.xxhash64("text")),
                        where, "place", "tie").select("shard", "doc_id", "text")
    done = sorted_rows.mapInArrow(run, "name string, temporary string, ids long, documents long").collect()
    manifest, start = [], 0
    for row in sorted(done, key=lambda r: r["name"]):  # one row per file
        files.move(row["temporary"], row["name"])
        manifest.append({"name": row["name"], "start": start, "ids": row["ids"], "documents": row["documents"]})
        start += row["ids"]
    files.write("_temporary/manifest", json.dumps({"files": manifest, "ids": start}).encode())
    files.move("_temporary/manifest", "MANIFEST.json")
    files.remove_folder("_temporary")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of the manifest."""
    manifest = json.loads(Files(folder).read("MANIFEST.json"))["files"]

    def run(batches):
        files = Files(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                matrix, docs, counts = WaveletMatrix.from_bytes(files.read(name))
                ids = matrix.decode()
                ends = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + ends[:-1]), pa.array(counts.astype(np.int64)),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(m["name"], m["start"], i) for i, m in enumerate(manifest)],
                                  "name string, start long, no int")
    return names.repartitionById(len(manifest), F.col("no")).select("name", "start").mapInArrow(run, schema)


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of `documents` to a new shared folder and read them back."""
    folder = shared_folder(documents.sparkSession, "token-ids")
    write_ids(documents, tokenizer, folder)
    return read_ids(documents.sparkSession, folder)
