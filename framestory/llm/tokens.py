"""Token counts of whole texts with a given tokenizer file."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framestory.llm.common import text_rows

CACHED_WORDS = 150_000
BYTES = 4
#: A-Z in lower case, other bytes as they are.
LOWER = bytes(range(256)).lower()
#: The first byte of characters from U+0300 on.
COMBINING = re.compile(rb"[\xcc-\xff]")
#: The preparation of texts that lets words and pieces be encoded on their own.
PREPARATION = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


def _plain_pieces() -> tuple[re.Pattern, re.Pattern]:
    """Words of characters that no normalisation changes, and their pieces: runs of letters, single digits, runs of marks.

    Letters and digits go up to U+024F; marks are those of ASCII but the
    apostrophe, which may join what follows it.
    """
    low = [chr(i) for i in range(0x250)]
    letters = "".join(c for c in low if unicodedata.category(c)[0] == "L" and c.lower() == c)
    digits = "".join(c for c in low if unicodedata.category(c)[0] == "N")
    marks = "".join(c for c in low[0x21:0x7F] if not c.isalnum() and c != "'")
    a, n, m = (f"[{re.escape(x)}]" for x in (letters, digits, marks))
    return re.compile(f"(?:{a}|{n}|{m})+"), re.compile(f"{a}+|{n}|{m}+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids (little-endian, 32 bit) of a text, word by word.

    Where the file prepares texts as in ``PREPARATION`` (read from the file),
    blanks are dropped and pieces are encoded on their own, so a text's ids are
    its words' ids in a row.  Words and pieces are remembered, A-Z in lower case
    unless a text has characters from U+0300 on; pieces of plain characters go to the model directly, other words through the
    whole tokenizer.  With any other preparation, and in texts with the mark of a
    special token, whole texts are encoded.  What is remembered is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_word = all(made.get(k) == v for k, v in PREPARATION.items()) and made["model"]["type"] == "BPE"
        self.marks = [a["content"].lower().encode() for a in made.get("added_tokens", [])]
        self.encode = getattr(t, "encode_batch_fast", t.encode_batch)
        self.model = t.model
        self.plain, self.cut = _plain_pieces()
        self.letters = _byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)] if texts else []

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _learn(self, words: set[bytes]) -> None:
        new, old, odd = self.new, self.old, []
        for w in words:
            if w in old:
                new[w] = old[w]
                continue
            s = w.decode()
            if self.plain.fullmatch(s):
                new[w] = b"".join(map(self._piece, self.cut.findall(s)))
            else:
                odd.append(w)
        for w, ids in zip(odd, self._encoded([w.decode() for w in odd])):
            new[w] = ids

    def ids(self, text: str) -> bytes:
        given = text.encode("utf-8", "replace")
        raw = given.translate(LOWER)
        if not self.by_word or any(m in raw for m in self.marks):
            return self._encoded([given.decode()])[0]
        if COMBINING.search(raw):  # a mark may combine with the small letter only, so these words keep their case
            raw = given
        words = raw.replace(b"\n", b" ").split(b" ")
        if len(self.new) > CACHED_WORDS:
            self.old, self.new = self.new, {}
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
        self._learn({w for w in words if w not in self.new})
        return b"".join(map(self.new.__getitem__, words))


def token_pieces(notes: DataFrame, tokenizer: str, capacity: int, key: str = "failure_id", text: str = "notes", end_id: int = 0) -> DataFrame:
    """Each whole text's ids, then ``end_id``, in pieces of at most ``capacity``.

    Returns ``key``, ``piece`` (from 0), ``start``, ``length`` and ``ids_crc32``
    (of the ids as unsigned 32-bit numbers).  Null or empty text is ``end_id``
    alone; null keys and repeated rows are kept.  ``tokenizer`` is a path that
    every executor has.
    """
    d = text_rows(notes, key, text)
    kind = d.schema["_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in frames:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(pdf["_text"]):
                ids = encoder.ids(t) + end
                for p in range(0, len(ids), capacity * BYTES):
                    part = ids[p:p + capacity * BYTES]
                    at.append(i)
                    piece.append(p // (capacity * BYTES))
                    start.append(p // BYTES)
                    length.append(len(part) // BYTES)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[at] if len(pdf) else pdf["_id"], "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return d.mapInPandas(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", key)
