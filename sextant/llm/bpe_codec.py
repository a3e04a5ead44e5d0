"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one last token belongs to its encoding: a token t that ends there
and that goes together with the last token p of the prefix before it, which is so if p + t encodes as
[p, t]. An Aho-Corasick automaton (suffix links over the vocabulary) lists the tokens that end at
each place; the last tokens found are stored, and following them back from the end gives the ids.
Pair tests are remembered. Text is prepared as the vocabulary file says: NFC, blanks to one
space, lower case, words cut by the file's pattern, bytes as visible characters, a mark on each word's last.

Nulls and empty texts give no ids. Rows are independent: repeated rows give repeated results, any
other columns may be there. Long texts are cut before blanks, which no token crosses; memory holds
one piece and a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import bounded_batches

PIECE_CHARS, CACHED_WORDS, CACHED_PAIRS = 1 << 20, 250_000, 500_000
END = "\x00"  # stands for the mark of a word's end; no visible byte character
BLANK = regex.compile(r"\p{White_Space}+")


def visible_bytes() -> list[str]:
    """Byte -> character of the byte-level alphabet: printable Latin-1 stays, the others follow from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = (b for b in range(256) if b not in set(kept))
    table = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


class WordCodec(dict):
    """word -> (number of ids, ids as little-endian 32-bit, tokens joined by spaces); remembers words."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        inner = lambda token: token[: -len(suffix)] + END if token.endswith(suffix) and len(token) > len(suffix) else token
        self.text_of = {i: token for token, i in model["vocab"].items()}
        self.plain = {inner(token): i for token, i in model["vocab"].items()}
        self.string = {i: token for token, i in self.plain.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(inner(a), inner(b)): k for k, (a, b) in enumerate(merges)}
        self.ends = ahocorasick.Automaton()
        for token, i in self.plain.items():
            self.ends.add_word(token, (len(token), i))
        self.ends.make_automaton()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = visible_bytes()
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Plain merging, lowest rank first; only for one or two tokens at a time."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def symbols(self, text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(END) else [*text]

    def fit(self, before: int, token: int) -> bool:
        """Whether both encode as themselves side by side; before is -1 at a word's start."""
        known = self.fits.get((before, token))
        if known is None:
            wanted = [self.string[token]] if before < 0 else [self.string[before], self.string[token]]
            known = self.merged(self.symbols("".join(wanted))) == wanted
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            self.fits[before, token] = known
        return known

    def encode(self, word: str) -> list[int]:
        text = "".join(map(self.bytes.__getitem__, word.encode())) + END
        last, start = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for at, (size, token) in self.ends.iter(text):
            end = at + 1
            begin = end - size
            if last[end] < 0 and (begin == 0 or last[begin] >= 0) and self.fit(last[begin] if begin else -1, token):
                last[end], start[end] = token, begin
        ids, end = [], len(text)
        while end:
            if last[end] < 0:
                raise ValueError(f"no encoding for {word!r}")
            ids.append(last[end])
            end = start[end]
        return ids[::-1]

    def __missing__(self, word: str) -> tuple[int, bytes, str]:
        ids = self.encode(word)
        found = len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.text_of.__getitem__, ids))
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) < 200:
            self[word] = found
        return found

    def prepared(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at what follows a sigma
        return BLANK.sub(" ", text).lower()

    def pieces(self, text: str):
        """(number of ids, ids, tokens) part by part."""
        for piece in cut(text):
            for k, part in enumerate(self.special_at.split(piece) if self.special_at else [piece]):
                if k % 2:
                    yield 1, struct.pack("<I", self.special[part]), part
                elif part and (found := [self[w] for w in self.words.findall(self.prepared(part))]):
                    yield sum(map(itemgetter(0), found)), b"".join(map(itemgetter(1), found)), " ".join(map(itemgetter(2), found))


def cut(text: str):
    """Pieces of about PIECE_CHARS, cut before a space or line end."""
    a = 0
    while len(text) - a > PIECE_CHARS:
        spots = [b for b in (text.find(" ", a + PIECE_CHARS), text.find("\n", a + PIECE_CHARS)) if b >= 0]
        if not spots:
            break
        yield text[a : min(spots)]
        a = min(spots)
    yield text[a:]


def _codec(source: bytes) -> WordCodec:
    """The worker's codec; it stays until a task of another kind begins there, with the words and pairs it remembers."""
    key = hash(source)
    if key not in bs.KEPT:
        bs.KEPT.clear()
        bs.KEPT[key] = WordCodec(source)
    return bs.KEPT[key]


def _coded(source, with_ids: bool):
    def coded(batches):
        codec = _codec(source.value)
        for ids, texts in bs.arrow_batches(batches, ["doc_id", "text"], keep=True):
            n, packed, encoded, decoded = [], [], [], []
            for text in texts:
                count, id_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for k, raw, tokens in codec.pieces(text.as_py() or ""):
                    text_hash.update((" " * (count > 0) + tokens).encode())
                    id_hash.update(raw)
                    count += k
                    if with_ids:
                        kept.append(raw)
                n.append(count)
                packed.append(b"".join(kept))
                encoded.append(id_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            columns = [ids, pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return coded


def bpe_encode(documents: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary of little-endian 32-bit]) per row.

    vocabulary is the path of a BPE vocabulary in JSON with an end-of-word mark. The driver reads it
    and broadcasts it: its size is fixed, about 3 MB, whatever the corpus.
    """
    with open(vocabulary, "rb") as f:
        source = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(_coded(source, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text): tokens joined by spaces, as the library decodes without a decoder. Null ids give null."""
    with open(vocabulary, "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches):
        codec = _codec(source.value)
        names = codec.text_of | {i: t for t, i in codec.special.items()}
        for docs, ids in bs.arrow_batches(batches, ["doc_id", "ids"], keep=True):
            text = [None if x is None else " ".join(names[i] for (i,) in struct.iter_unpack("<I", x)) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([docs, pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def op10_bpe_codec(spark, sf_dir):
    import public_tokenizers

    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
