"""What the tokenizer operators share: loading a public tokenizer in a task, cutting texts, and bounded memos.

Both vocabularies split a text into fragments that are merged on their own, so the ids of a text are those of its
fragments in turn. A memo keeps what the library answered for a fragment; it holds two generations of bounded size, and
a fragment that was not asked for during a whole generation is forgotten.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa

#: Characters of one segment of a long text, and entries and bytes (about) of one generation of a memo.
SEGMENT_CHARS = 1 << 18
MEMO_ENTRIES, MEMO_BYTES = 500_000, 128 << 20
#: Bytes that an entry takes besides its key and value.
_ENTRY = 200
#: Characters of the texts whose fragments are looked up together.
GROUP_CHARS = 1 << 20
#: The same where texts are cut as arrays, which take less room.
ARRAY_CHARS = 1 << 21

#: Characters on which Python's classes agree with those of the vocabularies.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\t-\r\x20-\x7e{LETTERS}¡«»¿–—‘-”…]*")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r\x20]+")
#: Marks a key that only the library can encode; no plain text holds it.
_ODD = "\uffff"
_SPACE = re.compile(r"\s")

#: Classes of UTF-8 bytes. Letters beyond ASCII begin with one of three bytes, which three other characters share.
_SYMBOL, _BLANK, _DIGIT, _LETTER = range(4)
_CLASSES = np.full(256, _SYMBOL, np.uint8)
_CLASSES[[*range(9, 14), 32]] = _BLANK
_CLASSES[48:58] = _DIGIT
_CLASSES[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_NO_LETTERS = [int.from_bytes(x.encode(), "big") for x in "×÷İ"]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Memo(dict):
    """Answers of ``resolve`` by key, in two generations of at most ``most`` entries and ``most_bytes`` bytes."""

    def __init__(self, resolve: Callable, most: int = MEMO_ENTRIES, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.resolve, self.most, self.most_bytes, self.held, self.old = resolve, most, most_bytes, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.resolve(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most or self.held >= self.most_bytes:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += _ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        self[key] = value

    def rest(self) -> None:
        """Gives back the older generation, when a task has ended."""
        self.old = {}


class BatchMemo(Memo):
    """A memo that resolves many keys at once: ``learn`` what a batch needs, then look up."""

    def __init__(self, resolve_all: Callable[[list], list], most: int = MEMO_ENTRIES, most_bytes: int = MEMO_BYTES):
        super().__init__(lambda key: resolve_all([key])[0], most, most_bytes)
        self.resolve_all = resolve_all

    def learn(self, lists: list[list]) -> None:
        missing = set()
        for keys in lists:
            missing.update(filterfalse(self.__contains__, keys))
        fresh = list(missing.difference(self.old))
        found = {x: self.old[x] for x in missing.intersection(self.old)}
        found.update(zip(fresh, self.resolve_all(fresh), strict=True))
        for key, value in found.items():
            self.keep(key, value)


def word_encoder(of_words: Callable[[list[str]], list[bytes]], library, most_bytes: int = MEMO_BYTES) -> BatchMemo:
    """A memo from the keys of a text to their ids, as little-endian 32-bit numbers."""

    def of_keys(keys: list[str]) -> list[bytes]:
        plain = [x for x in keys if not x.startswith(_ODD)]
        found = dict(zip(plain, of_words(plain), strict=True))
        return [found[x] if x in found else packed_ids(library.encode(x[1:], add_special_tokens=False).ids) for x in keys]

    return BatchMemo(of_keys, most_bytes=most_bytes)


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoded(rows: Iterator[tuple[int, str]], encoder: BatchMemo) -> Iterator[tuple[list[int], list[bytes]]]:
    """Keys and packed ids of the rows, in groups of about ``GROUP_CHARS``."""
    group: list[tuple[int, list[list[str]]]] = []
    held = 0

    def done() -> tuple[list[int], list[bytes]]:
        encoder.learn([x for _, lists in group for x in lists])
        return ([key for key, _ in group],
                [b"".join(b"".join(map(encoder.__getitem__, x)) for x in lists) for _, lists in group])

    for key, text in rows:
        group.append((key, list(keys(text))))
        held += len(text)
        if held >= GROUP_CHARS:
            yield done()
            group, held = [], 0
    if group:
        yield done()


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of a text in UTF-8; all bytes of a character have one class."""
    kinds = _CLASSES[data]
    wide = np.flatnonzero(data >= 0xC3)
    wide = wide[kinds[wide] == _LETTER]
    kinds[wide + 1] = _LETTER
    other = wide[np.isin(data[wide].astype(np.int64) << 8 | data[wide + 1], _NO_LETTERS)]
    kinds[other] = kinds[other + 1] = _SYMBOL
    return kinds


def runs(kinds: np.ndarray) -> np.ndarray:
    """True where a run of one class begins; each digit is a run."""
    begins = kinds == _DIGIT
    begins[:1] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    return begins


def _contract(data: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
    """Joins an apostrophe that is a run with the English ending after it. The data must end in white space."""
    at = np.flatnonzero(data[:-1] == ord("'"))
    at = at[begins[at] & (kinds[at + 1] == _LETTER)]
    first, second = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(first, list(b"stmd"))
    long = np.isin(first, list(b"rv")) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True


def cut(joined: bytes, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The text in pieces that begin where ``begins`` is true, without a copy, and their places."""
    offsets = np.append(np.flatnonzero(begins).astype(np.int32), np.int32(len(joined)))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined)), offsets


def groups(rows: Iterator[tuple], most: int = ARRAY_CHARS) -> Iterator[list[tuple]]:
    """Rows in lists whose texts, the last column, have about ``most`` characters."""
    group, held = [], 0
    for row in rows:
        group.append(row)
        held += len(row[-1]) + 1
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def word_counts(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """The distinct lower-cased runs of letters of the texts, and how often each is met."""
    joined = "\n".join(texts).lower().encode()
    data = np.frombuffer(joined, np.uint8)
    kinds = classes(data)
    begins = runs(kinds)
    pieces, places = cut(joined, begins)
    counted = pieces.filter(pa.array(kinds[places[:-1]] == _LETTER)).value_counts()
    return counted.field("values"), counted.field("counts")


def listed(texts: list[str], encoder: BatchMemo) -> pa.ListArray:
    """The ids of each text. A key (as ``keys`` gives them) that many texts hold is looked up once; white space has no ids."""
    made, first, odd, at = [], [], [], 0
    for text in texts:
        first.append(at)
        for part in segments(text, _SPACE):
            if _is_plain(part):
                made.append(part.lower().encode())
            else:
                found = [(_ODD + x).encode() for x in chunks(part)]
                odd.append((at, [len(x) for x in found]))
                made.append(b"".join(found))
            made.append(b"\n")
            at += len(made[-2]) + 1
    joined = b"".join(made)
    data = np.frombuffer(joined, np.uint8)
    kinds = classes(data)
    begins = runs(kinds)
    _contract(data, kinds, begins)
    begins[first] = True
    for start, lengths in odd:
        places = np.cumsum([start, *lengths])
        begins[start:places[-1]] = False
        begins[places] = True
    pieces, places = cut(joined, begins)
    pieces = pieces.dictionary_encode()
    found = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    encoder.learn([[x for x in found if not x.isspace()]])
    ids = [b"" if x.isspace() else encoder[x] for x in found]
    sizes = np.cumsum([0, *map(len, ids)]) // 4
    whole = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))).take(pieces.indices)
    starts = np.append(np.searchsorted(places, first), len(whole))
    return pa.ListArray.from_arrays(whole.offsets.take(pa.array(starts)), whole.values)


def segments(text: str, cut: re.Pattern, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before matches of ``cut``; one piece where none is found."""
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found or found.start() <= start:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


def _is_plain(part: str) -> bool:
    return "<|" not in part and _PLAIN.fullmatch(part) is not None


def keys(text: str) -> Iterator[list[str]]:
    """What a text is merged by, in lists: lower-cased words and symbol runs, or runs between white space of an odd text."""
    for part in segments(text, _SPACE):
        if _is_plain(part):
            yield _PARTS.findall(part.lower())
        else:
            yield [_ODD + x for x in chunks(part)]


def chunks(text: str) -> list[str]:
    """Runs between white space. Python's split also takes four control characters for white space."""
    if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [x for x in re.split("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if x]
