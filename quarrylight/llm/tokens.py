"""Token ids of texts by a public byte-level BPE tokenizer, long texts in parallel.

Tree concatenation: a text longer than ``LONG`` characters is cut into parts, the
parts are encoded by different tasks, and neighbours are joined in a tree.  A cut
is put where the tokenizer always splits, and joining is then concatenation; in
text that it never splits, the tokens around the join are encoded again in a
window that grows until its outermost tokens agree with those outside on both
sides.  A token sequence is the encoding of its bytes if and only if each
neighbouring pair is the encoding of the pair's bytes, so agreement of the edge
pairs makes the join exact, not approximate.

Defined results: null and empty texts have an empty list of ids; blank texts have
the ids of their blanks; strings of special tokens are ordinary text; a repeated row comes out again,
unless its text is long; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every function that encodes.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters above which a text is cut, and the length of its parts.
LONG = 20_000
#: Tokens on either side of a join in the first window.
FIRST_WINDOW = 8
#: Fixed value: how the byte-level tokenizer splits text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN)
_CLASS = regex.compile(r"(\s)|(\p{L})|(\p{N})|(.)", regex.S)


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS, name: str = NAME):
    """The tokenizer, loaded once per worker."""
    import tiktoken

    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _class(c: str) -> int:
    return _CLASS.match(c).lastindex


def cuts(text: str, size: int) -> list[tuple[int, bool]]:
    """(position, is a sure boundary) of the cuts between parts of about ``size`` characters."""
    out: list[tuple[int, bool]] = []
    reach = max(1, size // 8)
    at = size
    while at < len(text) - 1:
        sure = inside = None
        for i in range(at, min(at + reach, len(text) - 1)):
            a, b = text[i - 1], text[i]
            if a == "'" or b == "'":
                continue
            ca, cb = _class(a), _class(b)
            if ca != 1 and cb != 1:
                if ca != cb:
                    sure = i
                    break
                inside = inside or i
            elif ca != 1 and b == " " and _class(text[i + 1]) != 1 and text[i + 1] != "'":
                sure = i
                break
        if sure or inside:
            out.append((sure or inside, sure is not None))
            at = out[-1][0] + size
        else:
            at += reach  # blanks alone: they can't be cut
    return out


def join(left: list[int], left_text: str, right: list[int], right_text: str, enc) -> list[int]:
    """Ids of the joined text where the cut lies inside an unsplit piece."""
    size = enc.decode_single_token_bytes
    tail = _last_piece(left_text).encode()
    head = _PIECES.match(right_text)[0].encode()
    nl = _count_back(left, len(tail), size)
    nr = _count_on(right, len(head), size)
    k = FIRST_WINDOW
    while True:
        wl, wr = min(k, nl), min(k, nr)
        a, b = len(left) - wl, wr
        new = enc._encode_single_piece(b"".join(map(size, left[a:])) + b"".join(map(size, right[:b])))
        ok_left = wl == nl or (new[0] == left[a] and _fits(left[a - 1], new[0], enc))
        ok_right = wr == nr or (new[-1] == right[b - 1] and _fits(new[-1], right[b], enc))
        if ok_left and ok_right:
            return left[:a] + new + right[b:]
        k *= 2


def _last_piece(text: str) -> str:
    """The piece that ends a text: the trailing run of one class with the blank before it, or a contraction."""
    c, i = _class(text[-1]), len(text) - 1
    while i > 0 and _class(text[i - 1]) == c:
        i -= 1
    return [m[0] for m in _PIECES.finditer(text, max(0, i - 64))][-1]


def _count_back(ids: list[int], n: int, size) -> int:
    k = 0
    while n > 0:
        k += 1
        n -= len(size(ids[-k]))
    return k


def _count_on(ids: list[int], n: int, size) -> int:
    k = 0
    while n > 0:
        n -= len(size(ids[k]))
        k += 1
    return k


def _fits(a: int, b: int, enc) -> bool:
    pair = enc.decode_single_token_bytes(a) + enc.decode_single_token_bytes(b)
    return enc._encode_single_piece(pair) == [a, b]


def join_all(parts: list[tuple[str, list[int], bool]], enc) -> list[int]:
    """Ids of a text from its parts (text, ids, whether the cut before it is a sure boundary), by a tree of joins."""
    nodes = parts
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes) - 1, 2):
            (lt, li, sure), (rt, ri, cut) = nodes[i], nodes[i + 1]
            above.append((lt + rt, li + ri if cut else join(li, lt, ri, rt, enc), sure))
        nodes = above + nodes[len(nodes) // 2 * 2 :]
    return nodes[0][1]


def encode_tree(text: str, enc, size: int) -> list[int]:
    """Ids of one text through parts of ``size`` characters."""
    at = [(0, True), *cuts(text, size), (len(text), True)]
    parts = [(text[a:b], enc.encode_ordinary(text[a:b]), sure) for (a, sure), (b, _) in zip(at, at[1:])]
    return join_all(parts, enc)


# -- Spark ------------------------------------------------------------------------------------------------------------

_LIST = pa.list_(pa.int32())


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, long: int = LONG) -> DataFrame:
    """(key, ids): one row per row of the table."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, _LIST)], ["key", "ids"])

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                at = [(0, True), *cuts(t, long), (len(t), True)]
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type),
                        pa.array([batch.column(2)[i].as_py()] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array([sure for _, sure in at[:-1]], pa.bool_()),
                        pa.array([t[a:b] for (a, _), (b, _) in zip(at, at[1:])], pa.string()),
                    ],
                    ["key", "hash", "part", "sure", "text"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            ids = pa.array([enc.encode_ordinary(t) for t in batch.column(4).to_pylist()], _LIST)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["key", "hash", "part", "sure", "text", "ids"])

    def join_rows(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        ids = join_all([(p["text"], p["ids"], p["sure"]) for p in parts], encoding(folder, name))
        return pa.table({"key": pa.array([parts[0]["key"]], table.schema.field("key").type), "ids": pa.array([ids], _LIST)})

    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(short_rows, f"key {kind}, ids array<int>")
    # Parts of one text go to as many tasks; equal rows with a long text come out once, texts that share a key apart.
    part = f"key {kind}, hash long, part int, sure boolean, text string"
    parts = (
        rows.filter(is_long)
        .withColumn("hash", F.xxhash64("text"))
        .mapInArrow(cut_rows, part)
        .repartition("key", "hash", "part")
        .mapInArrow(encode_parts, f"{part}, ids array<int>")
    )
    joined = parts.dropDuplicates(["key", "hash", "part"]).groupBy("key", "hash").applyInArrow(join_rows, f"key {kind}, ids array<int>")
    return short.unionByName(joined).withColumnRenamed("key", key)


def sizes(documents: DataFrame, *keep: str, text: str = "text", folder: str = TOKENIZERS, name: str = NAME, long: int = LONG) -> DataFrame:
    """The kept columns with ``n_tokens`` of each row; null and empty texts have 0.  Long texts are counted through their parts."""
    out = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    is_long = F.coalesce(F.length(text) > long, F.lit(False))
    short = documents.filter(~is_long).select(*keep, text).mapInArrow(run, out)
    large = documents.filter(is_long).select(*keep, F.col(text).alias("_text"), F.md5(text).alias("_md5"))
    ids = encode(large.groupBy("_md5").agg(F.first("_text").alias("_text")), "_md5", "_text", folder, name, long)
    counted = large.drop("_text").join(ids.select("_md5", F.size("ids").cast("long").alias("n_tokens")), "_md5")
    return short.unionByName(counted.drop("_md5"))
