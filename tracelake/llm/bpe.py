"""Byte-level BPE encoding and decoding by monoid tree reduction.

Every text is halved recursively down to leaves of LEAF characters that are encoded independently; halves are then joined
up the tree. A join looks left and right of the boundary for an anchor: white space (blank or line feed) directly after a letter or digit. No
match of the split pattern crosses such a place, whatever stands around it, so every token outside the two anchors is
final and only the window between them is encoded again. The window grows until both anchors are found, or to the whole
node. Decoding concatenates the leaves' bytes up the same kind of tree.

Defined cases: null text counts as empty; an empty text has no tokens and the digest of nothing; repeated rows give
repeated results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import table, with_text_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 512
Encode = Callable[[str], list[int]]
_codecs: dict[str, object] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def codec(data: bytes, pattern: str):
    """The leaf encoder, made once a process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _codecs:
        import tiktoken

        _codecs[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})
    return _codecs[key]


def _anchor(text: str, i: int) -> bool:
    return text[i] in " \n" and text[i - 1].isalnum()


def join(text: str, start: int, mid: int, end: int, left: list[int], right: list[int], enc: Encode) -> list[int]:
    """Tokens of text[start:end] from those of text[start:mid] and text[mid:end]."""
    if _anchor(text, mid):
        return left + right
    s = mid - 1
    while s > start and not _anchor(text, s):
        s -= 1
    e = mid + 1
    while e < end and not _anchor(text, e):
        e += 1
    kept = len(left) - (len(enc(text[s:mid])) if s > start else len(left))
    gone = len(enc(text[mid:e])) if e < end else len(right)
    return left[:kept] + enc(text[s:e]) + right[gone:]


def encode(text: str, enc: Encode, leaf: int = LEAF) -> list[int]:
    def node(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return enc(text[start:end])
        mid = (start + end) // 2
        return join(text, start, mid, end, node(start, mid), node(mid, end), enc)

    return node(0, len(text))


def decode(ids: list[int], dec: Callable[[list[int]], bytes], leaf: int = LEAF) -> bytes:
    def node(start: int, end: int) -> bytes:
        if end - start <= leaf:
            return dec(ids[start:end])
        mid = (start + end) // 2
        return node(start, mid) + node(mid, end)

    return node(0, len(ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), keep_ids: bool = True) -> DataFrame:
    """One row per row of docs: the columns in keep, n_tokens, ids_sha256, decoded_sha256, and ids if keep_ids.

    vocabulary is a path of a rank file on the driver; its bytes (under 4 MB, checked) travel with the task.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 4 << 20:
        raise ValueError("the rank file is too large to be sent with every task")

    def make():
        c = codec(data, pattern)
        names = [str(i) for i in range(c.n_vocab)]

        def compute(texts: list[str | None]) -> list[list]:
            n, digests, backs, all_ids = [], [], [], []
            for t in texts:
                ids = encode(t or "", c.encode_ordinary)
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                backs.append(hashlib.sha256(decode(ids, c.decode_bytes)).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            return [n, digests, backs, *[all_ids] * keep_ids]

        return compute

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return with_text_columns(docs, list(keep), make, added)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return encode_documents(table(spark, sf_dir, "documents"), p.path(VOCABULARY), p.PATTERN, keep_ids=False)
