"""Token IDs of documents in sorted-string-table shards.

Documents are dealt out and sorted by ``(id, crc32 of the text)``; each task
tokenizes its range and writes one table, whose keys are document identifiers and
whose values are little-endian token IDs of 2 bytes (or 4, if the vocabulary needs
them).  Tasks write under names of their own, and only the files that the manifest
lists count, so a lost or repeated task leaves no trace in the result.

Tokenizing is by the given tokenizer.  Where its file says that its normalizer and
splitter never join characters across a space or line feed (``piecewise`` knows which
steps those are), equal pieces between those have equal IDs wherever they stand: a worker
keeps the IDs of the pieces that it has met (some ``MEMO`` of them) and encodes only new
ones; of those, words of Latin letters go to the tokenizer's merges at once.  Any other tokenizer gets whole texts.  ``tests/llm`` holds both against encoding
whole texts.

There are as many tables as shuffle partitions, or more so that none has over some
``shard_bytes`` of text; the manifest has each one's first and last key, so a lookup
opens only those that can hold it.

Edge cases: null texts count as empty and get just the end ID; null identifiers
come first; identifiers are integers or strings; repeated ones stay, in the order of
their texts' CRCs; an empty table gives empty shards; a text of any length is one entry;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from . import sstable
from .scratch import CACHES, fresh_path, release_memory, stage

MEMO, SEGMENT = 1_000_000, 4_000_000
_LONGEST = 48
#: Marks that end no word of a splitter's own (as apostrophes begin some) and stand in no special token.
_MARKS = ".,;:!?*&%$#\"-"
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("id_type", pa.string())])
_pieces: dict[tuple[str, int, bool], _Pieces] = {}

CACHES["token_tables"] = lambda: (_pieces.clear(), _tokenizer.cache_clear())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_width(path: str, end_id: int) -> int:
    """Bytes of a stored ID."""
    return 2 if max(_tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def _segments(text: str) -> Iterator[str]:
    """The text in parts of about ``SEGMENT`` characters, cut at spaces or line feeds."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        if cut < 0:
            cut = min((x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


#: The characters that stand for bytes in the vocabulary: printable ones for themselves, others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class _Pieces(dict):
    """IDs of the pieces between spaces, each encoded when it is met first."""

    def __init__(self, path: str, width: int, folded: bool) -> None:
        super().__init__()
        self.tok, self.kind, self.folded = _tokenizer(path), np.dtype(f"<u{width}"), folded
        self.merge = self.tok.model.tokenize
        # Words of Latin letters are merged at once, unless a special token could be found in them.
        self.direct = not any(x.content.isalpha() for x in self.tok.get_added_tokens_decoder().values())

    def _whole(self, p: str) -> bytes:
        return np.array(self.tok.encode(p, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, p: str) -> bytes:
        b = p.rstrip(_MARKS) if self.folded and not p[-1:].isalpha() else p
        if not b.isalpha() or not b.isascii() and max(b) > "\xff":
            found = self._whole(p) if p else b""
        elif b is not p and len(b) < len(p):
            found = self[b] + self[p[len(b) :]]
        elif self.folded and (low := b.lower()) != b:
            found = self[low]
        elif self.direct:
            shown = b if b.isascii() else b.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)
            found = np.array([t.id for t in self.merge(shown)], self.kind).tobytes()
        else:
            found = self._whole(b)
        if len(p) <= _LONGEST:  # long strings would fill the memory and seldom come again
            if len(self) >= MEMO:
                self.clear()
            self[p] = found
        return found


def encode_texts(texts: list[str], path: str, width: int, folded: bool) -> list[bytes]:
    """Little-endian IDs of each text, without special tokens added.

    ``folded``: the tokenizer lowers case and splits letters from marks, so a word
    of Latin letters with full stops or commas after it has its letters' IDs, then theirs.
    """
    if (path, width, folded) not in _pieces:
        _pieces[path, width, folded] = _Pieces(path, width, folded)
    get = _pieces[path, width, folded].__getitem__
    return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


# Splitters that take letters by themselves, drop white space and never cross it.
_SPLITTERS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


@lru_cache(maxsize=2)
def piecewise(path: str) -> str:
    """How a tokenizer's file allows to encode: "whole" texts only, "pieces" between spaces, or "folded" pieces, too.

    Pieces: it composes characters (NFC), lowers case, replaces white space by a space, splits by a known
    splitter that drops white space, maps bytes, and merges without chance; its added tokens hold no space.
    Folded: besides, it lowers case, so letters and the marks behind them have the IDs of each in lower case.
    """
    spec = json.loads(_tokenizer(path).to_str())

    def steps(of: dict | None, inside: str) -> list[dict]:
        return [] if of is None else of[inside] if of["type"] == "Sequence" else [of]

    normal = steps(spec.get("normalizer"), "normalizers")
    space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = [{"type": "Split", "pattern": {"Regex": r}, "behavior": "Removed", "invert": True} for r in _SPLITTERS]
    cut = steps(spec.get("pre_tokenizer"), "pretokenizers")
    to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    fine = (
        all(s == space or s == {"type": s["type"]} and s["type"] in ("NFC", "Lowercase") for s in normal)
        and len(cut) == 2 and cut[0] in split and {k: v for k, v in cut[1].items() if k != "trim_offsets"} == to_bytes
        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec.get("post_processor") is None
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
    )
    return "whole" if not fine else "folded" if {"type": "Lowercase"} in normal else "pieces"


def encode_all(texts: list[str], path: str, width: int) -> Iterator[bytes]:
    """``encode_texts`` over as many texts at a time as memory should hold."""
    how = piecewise(path)
    i = 0
    while i < len(texts):
        if how != "whole" and len(texts[i]) > SEGMENT:
            yield b"".join(encode_texts([s], path, width, how == "folded")[0] for s in _segments(texts[i]))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SEGMENT):
            size += len(texts[j])
            j += 1
        if how == "whole":
            yield from (np.array(e.ids, f"<u{width}").tobytes() for e in _tokenizer(path).encode_batch_fast(texts[i:j], add_special_tokens=False))
        else:
            yield from encode_texts(texts[i:j], path, width, how == "folded")
        i = j


def _open_fs(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_tables(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, folder: str | None = None, shards: int | None = None, shard_bytes: int = 1 << 27) -> DataFrame:
    """Write the shards; the manifest: (shard, file, docs, ids, bytes, first_key, last_key, id_type, docs_before, ids_before).

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-tables")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"identifiers are integers or strings, not {kind.simpleString()}")
    id_type = "string" if isinstance(kind, StringType) else "bigint"
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
        n = max(n, -(-total // shard_bytes))
    width = id_width(tokenizer, end_id)
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(keep="token_tables")
        fs, base = _open_fs(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.sst"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out:
            table = sstable.Writer(out)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, data in zip(ids, encode_all(texts, tokenizer, width), strict=True):
                    table.add(sstable.key_of(i), data + end, len(data) // width + 1)
            table.close()
            size = out.tell()
        row = {"shard": shard, "file": f"{folder}/{name}", "docs": table.entries, "ids": table.units, "bytes": size, "first_key": table.lowest, "last_key": table.last, "id_type": id_type}
        yield pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

    dealt = docs.select(F.col(f"`{id_col}`").cast(id_type).alias("id"), text.alias("text")).withColumn("c", F.crc32("text")).repartitionByRange(n, "id", "c").sortWithinPartitions("id", "c")
    manifest = stage(dealt.select("id", "text").mapInArrow(write, "shard int, file string, docs long, ids long, bytes long, first_key binary, last_key binary, id_type string"), "token-manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("docs", "ids")})


def read_tables(manifest: DataFrame, width: int) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of every entry in the shards' files, read block by block.

    ``ids_crc32`` is over the IDs as little-endian unsigned 32-bit integers.
    """
    kind = np.dtype(f"<u{width}")
    some = manifest.select("id_type").first()  # alike in all rows
    id_type = some.id_type if some else "bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = _open_fs(row["file"])
                with fs.open_input_file(base) as f:
                    table = sstable.Reader(f)
                    start = row["ids_before"]
                    for b in range(len(table.blocks)):
                        out: dict[str, list] = {"id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for key, data in table.block(b):
                            out["id"].append(sstable.value_of(key))
                            out["start"].append(start)
                            out["n_tokens"].append(n := len(data) // width)
                            out["ids_crc32"].append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
                            start += n
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.string() if id_type == "string" else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "ids_before").repartition(n, "file").mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, identifier: object, width: int) -> list[list[int]]:
    """Token IDs of one identifier's documents; opens the shards whose range holds it, and blocks only where their filter says that it may be."""
    found = []
    key = sstable.key_of(identifier)
    inside = (F.col("docs") > 0) & (F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))
    for row in manifest.filter(inside).orderBy("shard").select("file").toLocalIterator():
        fs, base = _open_fs(row["file"])
        with fs.open_input_file(base) as f:
            found += [np.frombuffer(v, f"<u{width}").tolist() for v in sstable.Reader(f).get(key)]
    return found
