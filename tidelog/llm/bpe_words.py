"""BPE encoding through a table of distinct words, and decoding through id-to-piece lookup.

1. Each block of documents lists its distinct words; its texts become places in that list.
2. The lists meet in buckets by a hash of the word. The table of distinct words of a bucket is
   encoded once.
3. The ids return to (block, place), and the blocks put their texts' ids together.
4. For decoding, each id is joined to its piece (a table as long as the vocabulary, sent to
   all tasks), once for each word of a block.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidelog.llm import blocks, tokens
from tidelog.llm.shared import written_by_key

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@cache
def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens stand for their text."""
    table = tokens.byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    found = {i: bytes(table[c] for c in piece) for piece, i in spec["model"]["vocab"].items()} | special
    return [found.get(i, b"") for i in range(max(found) + 1)]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null
    ids come out as they came in; an empty table gives an empty table.
    """
    table = written_by_key(blocks.word_blocks(docs, partial(tokens.numbered_words, cut="byte")), "bpe_blocks", "block")

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [blocks.unpack_words(x) for x in frame["words"]]
        distinct = list({w: None for words in lists for w in words})
        place = {w: i for i, w in enumerate(distinct)}
        ids, ends = tokens.encode_words(distinct, path, "byte")
        sizes = np.diff(ends, prepend=0)
        out = []
        for words in lists:
            own = np.fromiter((place[w] for w in words), np.int64, len(words))
            out.append(blocks.pack(np.concatenate(([len(own)], sizes[own], tokens.laid_out(ids, (ends - sizes)[own], sizes[own])))))
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "reply": out})

    replies = blocks.lists_by_bucket(table).drop("counts").groupBy("bucket").applyInPandas(encode, "block long, bucket int, reply binary")

    def assemble(row, replies: list[bytes], places: list[np.ndarray], n_words: int) -> pd.DataFrame:
        pieces = byte_pieces(path)
        shown, text, sizes = [""] * n_words, [b""] * n_words, np.zeros(n_words, np.int64)
        for reply, own in zip(replies, places):
            flat = blocks.unpack(reply)
            n = int(flat[0])
            sizes[own] = flat[1 : n + 1]
            ends, ids = np.cumsum(flat[1 : n + 1]).tolist(), flat[n + 1 :].tolist()
            for p, a, b in zip(own.tolist(), [0, *ends[:-1]], ends):
                shown[p] = ",".join(map(str, ids[a:b]))
                text[p] = b"".join([pieces[i] for i in ids[a:b]])
        out, at = [], 0
        flat = blocks.unpack(row.places)
        for doc_id, n in zip(row.doc_ids, row.lengths):
            own = flat[at : at + n].tolist()
            at += n
            decoded = b"".join([text[p] for p in own]).decode("utf-8", "replace")
            out.append((doc_id, int(sizes[own].sum()) if own else 0, hashlib.sha256(",".join([shown[p] for p in own]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return blocks.with_replies(table.drop("words"), replies, assemble, RESULT)
