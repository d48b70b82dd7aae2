"""Token ids of whole texts, each distinct word of a run of texts encoded once.

Two cuts of a text into words keep the ids of the whole text:

``byte``   byte-level vocabularies whose pattern never lets a piece run from a
           character that isn't white space into a following blank: the text is cut
           before each blank that follows such a character. The words add up to the text.
``space``  vocabularies that drop white space and mark the ends of words: the text is cut at
           blanks and line feeds.

Texts stay Arrow columns: Arrow cuts them and numbers their distinct words, and the ids of a word
are laid out by its number. Words of Latin letters, digits and marks are merged many at a time by
the vocabulary's own ranks (the tiktoken library), which gives the ids of the tokenizers library
for equal pieces; all other words go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and words, that are worked on at once. Bound memory, not results.
SLICE_BYTES = 12_000_000
SLICE_WORDS = 1_000_000
#: Words that one call of the tokenizers library gets.
TOGETHER = 1000

#: Bytes of a word that goes to the tokenizers library, whose time grows less with one piece.
LONG_WORD = 5000

_CUT = re.compile(r"(?<=\S)(?= )")
#: A blank at the start or after white space: there a piece may run on. (RE2; as in Unicode, and \x1c-\x1f.)
_GAP = r"^ |[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Words for the ranks: no white space inside but for lone line feeds. Beyond U+012F, vocabularies
#: that fold case leave a word to the tokenizers library.
_PLAIN = {"byte": r"^ ?[!-~\x{a1}-\x{24f}]+(\n[!-~\x{a1}-\x{24f}]+)*$", "space": r"^[!-~\x{c0}-\x{12f}]+$"}
#: Ends a piece of a vocabulary with word ends; parts words that are merged together.
_END, _NEXT = "\x01", "\x02"
#: How the vocabularies' files cut a word into pieces, for the characters of plain words.
_BYTE_PIECE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}\x02]++|\x02|\s"""
_SPACE_PIECE = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-į]+|[0-9]|\x02|[^a-zß-öø-į0-9\x02]+")

_loaded: dict[str, object] = {}


def byte_words(text: str) -> list[str]:
    return _CUT.split(text) if text else []


def space_words(text: str) -> list[str]:
    return [w for w in text.replace("\n", " ").split(" ") if w]


CUTS: dict[str, Callable[[str], list[str]]] = {"byte": byte_words, "space": space_words}


def tokenizer(path: str):
    """The tokenizer in ``path`` without truncation and padding, loaded once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies show for each byte, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def merger(path: str, cut: str) -> tuple[Callable[[str], np.ndarray], int] | None:
    """(ids of a plain text, the id that parts words); None where a vocabulary's ids aren't the ranks of its merges.

    A mark of the word's end counts as a byte of its own; its merges with single bytes come first."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = 512 if suffix else 256
    if (cut == "space") != bool(suffix) or any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {}
    for piece, i in vocab.items():
        ended = bool(suffix) and piece.endswith(suffix)
        stem = piece[: -len(suffix)] if ended else piece
        raw = bytes(letters[c] for c in stem) if all(c in letters for c in stem) else b""
        if raw and (len(raw) == 1 or not {1, 2} & set(raw)):
            ranks[raw + (_END.encode() if ended else b"")] = i
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    parting = _NEXT + (_END if suffix else "")
    core = tiktoken.Encoding("own", pat_str=r"[^\x01]+\x01" if suffix else _BYTE_PIECE, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def merge(words: str) -> np.ndarray:
        if suffix:
            words = "".join([x + _END for x in _SPACE_PIECE.findall(words.lower())])
        return np.frombuffer(core.encode_to_tiktoken_buffer(words, set()), "<u4")

    return merge, ranks[parting.encode()]


def _by_library(texts: list[str], path: str) -> Iterator[np.ndarray]:
    for k in range(0, len(texts), TOGETHER):
        for e in tokenizer(path).encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4")


def laid_out(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` with these starts and sizes, one after the other."""
    out = [ids[:0]]
    for a in range(0, len(starts), SLICE_WORDS):
        n = sizes[a : a + SLICE_WORDS]
        shift = starts[a : a + SLICE_WORDS] - (np.cumsum(n) - n)
        out.append(ids[np.arange(int(n.sum())) + np.repeat(shift, n)])
    return np.concatenate(out)


def _glued(*columns: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*columns, "")])


def encode_words(words: pa.Array | list[str], path: str, cut: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all words, and where each word's end. Plain words are merged many at a time."""
    words = pa.array(words, pa.large_string()) if isinstance(words, list) else words.cast(pa.large_string())
    merge = merger(path, cut)
    plain = np.zeros(len(words), bool)
    ids, sizes = [np.zeros(0, "<u4")], np.zeros(len(words), np.int64)
    if merge is not None and len(words):
        fits = pc.and_(pc.match_substring_regex(words, _PLAIN[cut]), pc.less_equal(pc.binary_length(words), LONG_WORD))
        plain = pc.and_not(fits, pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        if plain.any():
            own = _glued(words.filter(pa.array(plain)), _NEXT)
            edges = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            found = merge[0](own.buffers()[2][edges[0] : edges[-1]].to_pybytes().decode())
            parting = found == merge[1]
            ids[0] = found[~parting]
            sizes[plain] = np.diff(np.flatnonzero(parting) - np.arange(len(own)), prepend=0)
    rest = np.flatnonzero(~plain)
    for i, x in zip(rest.tolist(), _by_library(words.take(pa.array(rest)).to_pylist(), path)):
        ids.append(x)
        sizes[i] = len(x)
    order = np.concatenate((np.flatnonzero(plain), rest))
    starts = np.empty(len(words), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return (laid_out(np.concatenate(ids), starts, sizes) if len(rest) else ids[0]), np.cumsum(sizes)


def runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE_BYTES, null ones as empty; a longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        before = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield texts.slice(a, b - a)
        a = b


def numbered_words(texts: pa.Array, cut: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts, and where each text's words end."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if cut == "space" else texts, " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    if cut == "space":
        return coded.dictionary, coded.indices.to_numpy(), edges[1:]
    numbers, words = coded.indices.to_numpy().astype(np.int64), _glued(" ", coded.dictionary)
    own: dict[str, int] = {}
    add = lambda w: len(words) + own.setdefault(w, len(own))
    gaps = pc.match_substring_regex(texts, _GAP).to_numpy(zero_copy_only=False)
    starts = edges[:-1][~gaps]
    numbers[starts] = [add(w) for w in flat.take(pa.array(starts)).to_pylist()]
    if gaps.any():
        parts = np.split(numbers, edges[1:-1])
        for i in np.flatnonzero(gaps).tolist():
            cut_up = byte_words(texts[i].as_py())
            parts[i] = np.fromiter(map(add, cut_up), np.int64, len(cut_up))
        numbers, edges = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    return pa.concat_arrays([words, pa.array(list(own), pa.large_string())]), numbers, edges[1:]


def encode_arrow(texts: pa.Array | pa.ChunkedArray, path: str, cut: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ends) for one run of texts after the other: all ids of its texts, and where each text's end.
    A null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for run in runs(texts):
        words, numbers, edges = numbered_words(run, cut)
        ids, ends = encode_words(words, path, cut)
        sizes = np.diff(ends, prepend=0)
        own = sizes[numbers]
        yield laid_out(ids, (ends - sizes)[numbers], own), np.concatenate(([0], np.cumsum(own)))[edges]


def encode_texts(texts: Iterable[str | None], path: str, cut: str) -> Iterator[bytes]:
    """Ids of each whole text; a null text counts as empty."""
    for ids, ends in encode_arrow(pa.array(list(texts), pa.string()), path, cut):
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield ids[a:b].tobytes()
