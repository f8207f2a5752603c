"""Exact duplicates by compressed radix tries over whole texts.

Texts are dealt by length and content hash. Every task first merges its own copies in a trie, whose terminal nodes hold
the smallest id and the number of rows, so a text that fills a third of the corpus reaches the shuffle once per task. A
trie that grows beyond its budget spills its largest subtree downstream as ordinary rows. The owners of a partition get
their rows sorted by length and hash; a trie is closed only between two keys, so its memory is bounded and Spark's
sort does the rest.

Null text counts as empty and empty texts are one group. A null id owns a group only if the group has no other id;
``kept`` then holds for the rows without id. Repeated rows of one id are the same document: each is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rows, free_name, pair, rows_of

#: Bytes of text that one trie holds before it spills a subtree or is closed.
TRIE_BYTES = 24 << 20

PARTIAL = "n_bytes long, digest binary, text string, keep_id long, group_size long"
OWNERS = "n_bytes long, digest binary, keep_id long, group_size long"


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "children", "value", "size")

    def __init__(self, label: bytes, value: list | None = None):
        self.label, self.value = label, value
        self.children: dict[int, Node] = {}
        self.size = len(label)


class Trie:
    """A Patricia trie. Values are lists [smallest id, rows, ...]; equal keys are merged."""

    def __init__(self) -> None:
        self.root = Node(b"")

    @property
    def size(self) -> int:
        return self.root.size

    def insert(self, key: bytes, value: list) -> None:
        node, path, rest = self.root, [self.root], key
        while True:
            if not rest:
                if node.value is None:
                    node.value = value
                else:
                    ids = [x for x in (node.value[0], value[0]) if x is not None]
                    node.value[0] = min(ids) if ids else None
                    node.value[1] += value[1]
                return
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = Node(rest, value)
                for above in path:
                    above.size += len(rest)
                return
            common = shared_prefix(child.label, rest)
            if common < len(child.label):
                upper = Node(child.label[:common])
                upper.size = child.size
                child.label, child.size = child.label[common:], child.size - common
                upper.children[child.label[0]] = child
                node.children[rest[0]] = child = upper
            node, rest = child, rest[common:]
            path.append(node)

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            stack.extend((child, prefix) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Takes out the largest subtree below the root, and the root's own value."""
        if self.root.value is not None:
            yield b"", self.root.value
            self.root.value = None
        if self.root.children:
            first = max(self.root.children, key=lambda k: self.root.children[k].size)
            gone = self.root.children.pop(first)
            self.root.size -= gone.size
            yield from self.items(gone)


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("text", pa.string()),
                        ("keep_id", pa.int64()), ("group_size", pa.int64())])
    out, trie = Rows(schema), Trie()

    def sent(items):
        for key, (keep, rows, digest) in items:
            if out.add(len(key), digest, key.decode(), keep, rows, size=len(key)):
                yield from out.take()

    for ident, text, digest in rows_of(batches, "doc_id", "text", "digest"):
        trie.insert(text.encode(), [ident, 1, digest])
        while trie.size > TRIE_BYTES:
            yield from sent(trie.spill())
    yield from sent(trie.items())
    yield from out.take()


def _find_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64())])
    out, trie, last = Rows(schema), Trie(), None

    def sent():
        seen = set()
        for key, (keep, rows, digest) in trie.items():
            if (len(key), digest) in seen:
                raise ValueError("two texts of one length share a SHA-256")
            seen.add((len(key), digest))
            if out.add(len(key), digest, keep, rows):
                yield from out.take()

    for size, digest, text, keep, rows in rows_of(batches, "n_bytes", "digest", "text", "keep_id", "group_size"):
        if (size, digest) != last and trie.size > TRIE_BYTES:
            yield from sent()
            trie = Trie()
        trie.insert(text.encode(), [keep, rows, digest])
        last = size, digest
    yield from sent()
    yield from out.take()


def normalised(text):
    """Every run of white space as one space. Lone spaces, the common case, are no match."""
    return F.regexp_replace(text, r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: length in bytes, SHA-256, smallest id and number of rows."""
    texts = _texts(docs, doc_id, text).select("doc_id", "text", "digest")
    partial = texts.mapInArrow(_merge_copies, PARTIAL)
    dealt = partial.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return dealt.mapInArrow(_find_owners, OWNERS)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    plain = pair(docs, doc_id, text).withColumn("text", normalised(F.col("text")))
    return plain.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the id that owns its text, the size of its group, whether it stays, and the text's SHA-256."""
    narrow = _texts(docs, doc_id, text).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    joined = narrow.join(owners(docs, doc_id, text), ["n_bytes", "digest"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that own their text. Needs ``doc_id`` and ``text``.

    A row stays if its id and its text's hash are those of an owner; rows without id stay if no other row has the text.
    """
    own, keep = free_name(docs, "_digest"), free_name(docs, "_keep_id")
    known = owners(docs).select(F.col("digest").alias(own), F.col("keep_id").alias(keep))
    digest = F.unhex(F.sha2(normalised(F.coalesce("text", F.lit(""))), 256))
    return docs.join(known, (digest == F.col(own)) & docs["doc_id"].eqNullSafe(F.col(keep)), "left_semi")
