"""Token ids of a public tokenizer, by word.

Encoding a corpus repeats the same words over and over, and tokenizers of this kind never let a token cross white
space.  So the ids of each white-space separated chunk are kept by the worker in a bounded cache, and only new chunks
are encoded: plain ones all at once by the vocabulary's own merges, others by the tokenizer itself.  A tokenizer whose
steps are others than the expected ones encodes whole texts instead.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, slices, words_of

#: Fixed value: the splitting pattern for which chunks can be encoded apart.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose lower case, class and normal form are the same in every library.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")
_END = "</w>"
#: Chunks that a worker keeps; a call that would exceed them starts anew.
MAX_CHUNKS = 150_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _word_encoding(model: dict) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The merges of a vocabulary with word ends as an encoding of words that end in a zero byte, and its ids.

    A merge's rank is its place among the merges; letters join their word's end before anything else.
    """
    letters, vocabulary = _byte_letters(), model["vocab"]
    ranks, ids = {bytes([b]): b for b in range(256)}, [0] * 256
    for letter, b in letters.items():
        ids[b] = vocabulary[letter]
        if b:
            ranks[bytes([b, 0])] = len(ids)
            ids.append(vocabulary[letter + _END])
    for first, second in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        token = first + second
        core = bytes(letters[c] for c in token.removesuffix(_END))
        if 0 not in core and (key := core + b"\0" * token.endswith(_END)) not in ranks:
            ranks[key] = len(ids)
            ids.append(vocabulary[token])
    found = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
    return found, np.array(ids, dtype="<u4")


class Encoder:
    """encode(texts): for each text its ids as bytes, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        model = steps["model"]
        self.size = 1 + max([*model["vocab"].values(), *(x["id"] for x in steps.get("added_tokens", []))])
        pre = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (steps.get("normalizer") or {}).get("normalizers", [])]
        self.by_chunk = (
            pre[0].get("pattern") == {"Regex": _SPLIT}
            and kinds == ["NFC", "Replace", "Lowercase"]
            and model.get("end_of_word_suffix") == _END
            and not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"))
        )
        if self.by_chunk:
            self.words, self.ids = _word_encoding(model)
            self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
            self.ends[[i for w, i in model["vocab"].items() if w.endswith(_END)]] = True
            self.chunks: dict[bytes, bytes] = {}

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        if self.whole is None:  # takes memory that few workers need
            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _add_plain(self, chunks: list[bytes], text: str) -> None:
        """Adds chunks whose text, joined by spaces, is given.  Each piece ends with the one token of its own that
        carries the end-of-word mark."""
        pieces = _PIECES.findall(text.lower())
        ids = self.ids[self.words.encode_to_numpy("\0".join(pieces).replace("\0 \0", "\0") + "\0", disallowed_special=())]
        stops = np.flatnonzero(self.ends[ids]) + 1
        edges = np.flatnonzero(np.array([p == " " for p in pieces] + [True]))
        last = edges - np.arange(len(edges)) - 1  # the last piece of each chunk, counted without the spaces
        if len(stops) != len(pieces) + 1 - len(edges) or len(edges) != len(chunks):
            raise ValueError("the tokenizer marks other word ends than expected")
        data, bounds = ids.tobytes(), [0, *(4 * stops[last]).tolist()]
        self.chunks.update(zip(chunks, [data[i:j] for i, j in zip(bounds, bounds[1:])], strict=True))

    def _add_chunks(self, new: list[bytes]) -> None:
        if len(self.chunks) + len(new) > MAX_CHUNKS:
            self.chunks.clear()
        text = b" ".join(new).decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            self._add_plain(new, text)
            return
        named = list(zip(new, text.split(" "), strict=True))
        plain = [x for x in named if _PLAIN.fullmatch(x[1])]
        other = [x for x in named if not _PLAIN.fullmatch(x[1])]
        if plain:
            self._add_plain([c for c, _ in plain], " ".join([t for _, t in plain]))
        for (chunk, _), ids in zip(other, self._encode_whole([t for _, t in other]), strict=True):
            self.chunks[chunk] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._encode_whole(texts)
        words, bounds = words_of(texts)
        if not words:
            return [b""] * len(texts)
        met = list(dict.fromkeys(words))
        places = {c: i for i, c in enumerate(met)}
        which = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
        new = [c for c in met if c not in self.chunks]
        if len(self.chunks) + len(new) > MAX_CHUNKS:  # cleared on addition: everything of this call is new then
            new = met
        if new:
            self._add_chunks(new)
        ids = list(map(self.chunks.__getitem__, met))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        # The ids of every word in turn: where its chunk's begin, and so many from there.
        each = size[which]
        stops = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.arange(stops[-1]) + np.repeat((np.cumsum(size) - size)[which] - stops[:-1], each)]
        at = stops[bounds].tolist()
        return [out[i:j].tobytes() for i, j in zip(at, at[1:])]


    def forget(self) -> None:
        """Drops what has been kept of the texts so far."""
        if self.by_chunk:
            self.chunks.clear()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(documents: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_bytes: int = 0) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are its text's and end_id (null counts as empty).  Only longer ones are cut, every max_tokens.
    id_bytes: 0 for no ids, 4 or 2 for little-endian unsigned 32-bit or 16-bit ids (binary).  ids_crc32 is of 32-bit ids.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def pieces(batches):
        enc, end, width = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * max_tokens
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                rows, out = [], []
                for i, data in enumerate(enc.encode([t or "" for t in texts[first:last].to_pylist()]), first):
                    data += end
                    for k in range(0, len(data), width):
                        part = data[k : k + width]
                        rows.append((i, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
                        if id_bytes == 2:
                            part = np.frombuffer(part, "<u4").astype("<u2").tobytes()
                        out.append(part)
                at, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                columns = [ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if id_bytes:
                    columns, names = [*columns, pa.array(out, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        enc.forget()

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(pieces), schema + ", ids binary" * bool(id_bytes))
