"""Token ids in binary shards of patched frame-of-reference blocks.

A shard file holds whole documents, in key order, as one run of ids cut into blocks of 256. Of each block
the minimum is taken off and the rest is packed at the width that a stated share of the block (90 %) needs;
the high bits of what is wider stand in an exception list behind the block. The file ends with the offsets of
its blocks and the ends of its documents, so that any stretch of ids is read from its own blocks:

    "PFR1", u32 ids a block, u64 ids, u32 blocks, u32 documents
    blocks: u32 minimum, u8 width, u8 bytes of an exception, u16 exceptions, packed low bits,
            u8 places of the exceptions, their high bits
    index:  u64 offset of each block; i64 id, u8 "id is null" and u64 end (in ids) of each document
    u64 offset of the index, "PFR1"

Tasks write files under names of their own and return rows of a manifest, which Spark commits: a file that is
not in the manifest (of a lost or repeated task) is never read. The manifest orders shards by their first key
and gives each the number of ids before it.

Defined results: a null text counts as empty and has the end id only; repeated rows and null ids are documents
of their own, nulls first; ids that are not integers are kept as null or as the cast gives them; an empty table
gives no files and no rows; other columns are ignored. A text is at most what one row of Spark holds.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, shared_dir, small

BLOCK = 256
#: Share of a block that its width holds; the others are exceptions.
SHARE = 0.9
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 21
END = 1
#: Words whose ids a worker keeps, some 200 bytes each; beyond that it starts anew.
MOST_WORDS = 1 << 20
MAGIC = b"PFR1"
_HEAD, _BLOCK_HEAD, _FOOT = struct.Struct("<4sIQII"), np.dtype([("base", "<u4"), ("width", "u1"), ("size", "u1"), ("n", "<u2")]), struct.Struct("<Q4s")
MANIFEST = "file string, first long, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: A run of letters before a full stop or comma is a piece of its own whatever follows; so is what stands between blanks.
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,])|[^ \n]+")
_encoders: dict = {}


# --- blocks


def pack_blocks(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> list[bytes]:
    """The blocks of some ids (unsigned, 32 bits), each as bytes."""
    n_blocks = -(-len(ids) // block)
    out: list[bytes] = []
    for at in range(0, n_blocks, 512):
        part = ids[at * block : (at + 512) * block].astype(np.uint32)
        rows = -(-len(part) // block)
        grid = np.full(rows * block, part[-1], np.uint32)  # the last block is filled up with its last id
        grid[: len(part)] = part
        grid = grid.reshape(rows, block)
        base = grid.min(axis=1)
        rest = grid - base[:, None]
        bits = np.frexp(rest.astype(np.float64))[1]
        nth = max(0, int(np.ceil(share * block)) - 1)
        width = np.partition(bits, nth, axis=1)[:, nth]
        low = np.empty(rows, object)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            spread = (rest[of][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(spread.astype(np.uint8).reshape(len(of), block * int(w)), axis=1, bitorder="little")
            for i, row in zip(of.tolist(), packed):
                low[i] = row.tobytes()
        row_of, place = np.nonzero(bits > width[:, None])
        high = rest[row_of, place].astype(np.uint64) >> width[row_of].astype(np.uint64)
        first = np.searchsorted(row_of, np.arange(rows + 1))
        head = np.zeros(rows, _BLOCK_HEAD)
        head["base"], head["width"], head["n"] = base, width, np.diff(first)
        for i in range(rows):
            of = high[first[i] : first[i + 1]]
            size = 0 if not len(of) else 1 if of.max() < 1 << 8 else 2 if of.max() < 1 << 16 else 4
            head[i]["size"] = size
            out.append(head[i].tobytes() + low[i] + place[first[i] : first[i + 1]].astype(np.uint8).tobytes() + (of.astype(f"<u{size}").tobytes() if size else b""))
    return out


def unpack_blocks(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks at these offsets of a file (bytes), in their order."""
    head = np.ascontiguousarray(data[offsets[:, None] + np.arange(8)]).view(_BLOCK_HEAD).ravel()
    out = np.zeros((len(offsets), block), np.uint32)
    body = offsets + 8
    for w in np.unique(head["width"]):
        of, n = np.flatnonzero(head["width"] == w), block * int(w) // 8
        if w:
            for k in range(0, len(of), 512):
                some = of[k : k + 512]
                bits = np.unpackbits(data[body[some][:, None] + np.arange(n)], axis=1, bitorder="little").reshape(len(some), block, int(w))
                out[some] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    places = body + block * head["width"].astype(np.int64) // 8
    for size in (1, 2, 4):
        of = np.flatnonzero((head["n"] > 0) & (head["size"] == size))
        if len(of):
            n = head["n"][of].astype(np.int64)
            row, within = np.repeat(of, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = data[places[row] + within]
            at = places[row] + head["n"][row] + within * size
            high = np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(f"<u{size}").ravel().astype(np.uint32)
            out[row, place] |= high << head["width"][row].astype(np.uint32)
    return out + head["base"][:, None]


# --- shards


def shard_bytes(documents: list[tuple[int | None, np.ndarray]], block: int = BLOCK, share: float = SHARE) -> bytes:
    """A shard file of (id, ids) in this order."""
    ids = np.concatenate([x for _, x in documents]) if documents else np.zeros(0, np.uint32)
    blocks = pack_blocks(ids, block, share)
    ends = np.cumsum([len(x) for _, x in documents], dtype=np.uint64)
    offsets = _HEAD.size + np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    index = offsets[:-1].astype("<u8").tobytes() + np.array([i or 0 for i, _ in documents], "<i8").tobytes() + np.array([i is None for i, _ in documents], np.uint8).tobytes() + ends.astype("<u8").tobytes()
    return b"".join([_HEAD.pack(MAGIC, block, len(ids), len(blocks), len(documents)), *blocks, index, _FOOT.pack(int(offsets[-1]), MAGIC)])


class Shard:
    """A shard file in memory (bytes or a memory map); decodes the blocks that are asked for."""

    def __init__(self, data):
        self.data = np.frombuffer(data, np.uint8)
        magic, self.block, self.n_ids, n_blocks, n_docs = _HEAD.unpack(bytes(self.data[: _HEAD.size]))
        at, foot = _FOOT.unpack(bytes(self.data[-_FOOT.size :]))
        if magic != MAGIC or foot != MAGIC:
            raise ValueError("not a shard of token ids, or cut short")
        take = lambda kind, n: np.frombuffer(self.data, kind, n, at)
        self.offsets, at = take("<i8", n_blocks), at + 8 * n_blocks
        self.doc_ids, at = take("<i8", n_docs), at + 8 * n_docs
        self.null, at = take("u1", n_docs), at + n_docs
        self.ends = take("<i8", n_docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop (exclusive), of the blocks they lie in."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start}:{stop} of {self.n_ids} ids")
        a = start // self.block
        of = self.offsets[a : -(-stop // self.block)] if stop > start else self.offsets[:0]
        return unpack_blocks(self.data, of, self.block).ravel()[start - a * self.block : stop - a * self.block] if len(of) else np.zeros(0, np.uint32)

    def documents(self):
        """(id or null, first id's place in the shard, ids) of each document; some 256 blocks are decoded at a time."""
        begin, step, have, base = 0, 256 * self.block, np.zeros(0, np.uint32), 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.null.tolist(), self.ends.tolist()):
            if end > base + len(have):
                stop = min(self.n_ids, max(end, begin + step))
                have, base = self.ids(begin, stop), begin
            yield None if null else doc, begin, have[begin - base : end - base]
            begin = end


# --- tokens


def encoder(path: str):
    """texts -> ids (unsigned, 16 bits where the vocabulary allows it) as the tokenizer file gives them, special tokens not added.

    No piece of this kind of vocabulary goes over a blank, so each different piece between blanks is encoded
    once and its ids kept; pieces of Latin letters alone go to the library's merge model without its splitting
    step, which leaves them whole. Texts that spell a special token, and other vocabularies, are encoded whole.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        full = Tokenizer.from_file(path)
        model, as_bytes = full.model, ByteLevel(add_prefix_space=False)
        spelt = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x100) if chr(c).isalpha()}
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        kind, letter = ("<u2", "H") if full.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        whole = lambda text: np.array(full.encode(text, add_special_tokens=False).ids, kind)
        by_piece = "\\s+" in str(full.normalizer) and "Removed" in str(full.pre_tokenizer)  # blanks divide pieces and are dropped

        class Known(dict):
            """piece -> its ids as bytes."""

            def __missing__(self, p: str) -> bytes:
                if p.isalpha() and (p.isascii() or max(p) < "\u0100"):
                    low = p.lower()
                    found = [x.id for x in model.tokenize(low if low.isascii() else low.translate(spelt))]
                else:
                    found = full.encode(p, add_special_tokens=False).ids
                self[p] = out = array(letter, found).tobytes()
                return out

        known = Known()

        def encode(texts: list[str]) -> list[np.ndarray]:
            if len(known) > MOST_WORDS:
                known.clear()
            out = []
            for t in texts:
                try:
                    low = t.lower() if t.encode("latin-1") else t
                except UnicodeEncodeError:
                    low = t  # lower case of other letters is left to the library
                if not by_piece or any(s in low for s in special):
                    out.append(whole(t))
                else:
                    out.append(np.frombuffer(b"".join(map(known.__getitem__, _PIECES.findall(low))), kind))
            return out

        _encoders[path] = encode
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- Spark


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; Hadoop writes file:/x for file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, folder: str | None = None, shard_ids: int = SHARD_IDS, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """Write all documents as shard files into a shared folder; gives the manifest (a written table), with ``base``."""
    if block % 8 or not 8 <= block <= 256:
        raise ValueError("a block has 8 to 256 ids, a multiple of 8")
    path, folder = path or default_tokenizer(), (folder or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}").rstrip("/")
    rows = keyed(docs, id_col, text_col).select(RID, F.col("doc_id").try_cast("long"), "text").repartitionByRange(RID).sortWithinPartitions(RID)

    def run(batches):
        encode, (store, at) = encoder(path), _store(folder)
        store.create_dir(at)
        held, first, n, task, k = [], None, 0, uuid.uuid4().hex, 0

        def flush():
            nonlocal held, first, n, k
            file, data = f"{task}-{k}.pfr", shard_bytes(held, block, share)
            with store.open_output_stream(f"{at}/{file}") as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"file": file, "first": first, "n_docs": len(held), "n_ids": n, "n_bytes": len(data)}])
            held, first, n, k = [], None, 0, k + 1
            return row

        for b in batches:
            for part in small([b], 64):
                keys, ids, texts = (c.to_pylist() for c in part.columns)
                for key, doc, x in zip(keys, ids, encode([t or "" for t in texts])):
                    first = key if first is None else first
                    held.append((doc, np.append(x, x.dtype.type(end))))
                    n += len(x) + 1
                    if n >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    # numbered in key order; rows of one task of this sort are a block of the sums
    found = materialize(rows.mapInArrow(run, MANIFEST), "shards").orderBy("first").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    found = materialize(found.withColumn("folder", F.lit(folder)), "manifest")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("p0"))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("first"))), F.lit(0))
    return materialize(found.withColumn("w0", within).join(parts, "part").select("folder", "file", "first", "n_docs", "n_ids", "n_bytes", (F.col("p0") + F.col("w0")).alias("base")), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                store, at = _store(r["folder"])
                with store.open_input_file(f"{at}/{r['file']}") as f:
                    shard = Shard(f.read())
                rows = [(doc, r["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in shard.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in DOCUMENTS.split(", ")])

    n = manifest.count()
    return manifest.select("folder", "file", "base").repartition(max(1, min(n, 20_000))).mapInArrow(run, DOCUMENTS)


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents as token ids in shard files, read back."""
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
