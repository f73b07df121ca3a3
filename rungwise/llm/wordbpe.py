"""Byte-pair encoding of white-space chunks with a whole-token shortcut.

The tokenizer drops white space, and no ASCII white space lies inside a
pre-token, a special string or a canonical composition. A text's ids are
therefore the ids of its ASCII-white-space chunks, one after another. Some megabytes
of text are taken together: their distinct chunks are cut into pre-tokens at once, and every
pre-token's ids need working out once per worker.

`prove_whole` is the offline proof: it encodes every vocabulary string alone
and keeps those that come back as exactly that one token; `proof` has it run once. A pre-token among
them is one id, looked up; only the rest is merged.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters below U+0180 are composed, and have had fixed classes and simple lower cases in all Unicode versions in use; U+0130 lowers to two.
_LATIN = "\x21-\x7e¡-įı-ſ"
_FIXED = re.compile(f"[{_LATIN}]+")
_STRANGE = re.compile(f"[^ {_LATIN}]")


def _split() -> re.Pattern:
    """Pre-tokens of lower-cased text whose characters are those of _LATIN and spaces: contractions, runs of letters, single digits, runs of the rest."""
    known = [chr(c) for c in range(0x21, 0x180) if _FIXED.fullmatch(chr(c))]
    letters, digits = (re.escape("".join(c for c in known if of(c))) for of in (str.isalpha, str.isnumeric))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ {letters}{digits}]+")


_PIECES = _split()


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the others get U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


def prove_whole(path: str) -> dict[str, int]:
    """Text of each entry of a vocabulary file that encodes, alone, as that one token."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, back = model["end_of_word_suffix"], {c: b for b, c in byte_letters().items()}
    texts, ids = [], []
    for entry, i in model["vocab"].items():
        body = entry[: -len(end)] if entry.endswith(end) else None
        if body and all(c in back for c in body):
            try:
                texts.append(bytes(back[c] for c in body).decode("utf-8"))
            except UnicodeDecodeError:
                continue
            ids.append(i)
    got = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    return {t: i for t, i, e in zip(texts, ids, got, strict=True) if e.ids == [i]}


class ChunkCoder:
    """Maps texts to their ids, packed little-endian.

    About `limit` pre-tokens are remembered; then the memory starts anew,
    so a worker's memory is bounded whatever the text.
    """

    def __init__(self, path: str, whole: dict[str, int] | None = None, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # the same merges for words already cut out and spelt in byte letters
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items() if b != 0x20 and chr(b) != c}
        self.width = 2 if max(vocab.values()) < 65536 and self.tokenizer.get_vocab_size() <= 65536 else 4
        self.limit = limit
        self.end = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kind = np.dtype(f"<u{self.width}")
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(self.end)]] = True
        self.whole = {t: i.to_bytes(self.width, "little") for t, i in (prove_whole(path) if whole is None else whole).items()}
        self.words = dict(self.whole)

    def merge_all(self, words: list[str]) -> None:
        """Merges pre-tokens that are no whole tokens, many in one call; a word's ids end at the first id with the word-end mark."""
        self.merge_some([w for w in words if w.isascii()], False)  # printable ASCII stands for itself
        self.merge_some([w for w in words if not w.isascii()], True)

    def merge_some(self, words: list[str], spelt: bool, step: int = 256) -> None:
        texts = [" ".join(words[k : k + step]) for k in range(0, len(words), step)]
        if spelt:
            texts = [t.encode("utf-8").decode("latin-1").translate(self.letters) for t in texts]
        for k, got in enumerate(self.merger.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, dtype=self.kind)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.width).tolist()
            own, data = words[k * step : (k + 1) * step], ids.tobytes()
            self.words.update(zip(own, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def cut_up(self, chunks: list[str]) -> pa.Array:
        """Ids of chunks of known characters: one pass cuts all into pre-tokens, and a chunk's ids lie where its characters do."""
        pieces = _PIECES.findall(" ".join(chunks).lower())
        coded = list(map(self.words.get, pieces))
        if new := {w for w, x in zip(pieces, coded, strict=True) if x is None}:
            if len(self.words) + len(new) > self.limit + len(self.whole):
                self.words = dict(self.whole)
                new = set(pieces).difference(self.words)
            self.merge_all(list(new))
            coded = list(map(self.words.__getitem__, pieces))
        ids = pa.array(coded, pa.binary())
        # a chunk holds the pieces that, with those before, have no more characters than it and the chunks before
        reach = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.searchsorted(reach, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))), side="right")
        return joined(ids, ends)

    def strange(self, chunk: str) -> bool:
        return bool(_STRANGE.search(chunk)) or "<|" in chunk and any(s in chunk for s in self.special)

    def encode(self, texts: Iterable[bytes], most: int = 4 << 20) -> Iterator[bytes]:
        """The packed ids of each UTF-8 text."""
        for ids in self.packed(pa.array(texts, pa.binary()), most):
            yield from ids.to_pylist()

    def packed(self, texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
        """The packed ids of UTF-8 texts (binary, no nulls), in order, in arrays for some `most` bytes of text each."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy()) // most
        cuts = np.append(np.flatnonzero(np.diff(ends)) + 1, len(texts))
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            yield self.looked_up(texts.slice(a, b - a))
        pa.default_memory_pool().release_unused()  # a worker's neighbours need it

    def looked_up(self, texts: pa.Array) -> pa.Array:
        """The texts' ids: distinct chunks' ids are worked out together and put in the chunks' places."""
        lists = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = lists.flatten().dictionary_encode()
        met, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices
        whole = " ".join(met)
        if _STRANGE.search(whole) or "<|" in whole:  # the library encodes such chunks
            far = np.fromiter(map(self.strange, met), bool, len(met))
            got = self.tokenizer.encode_batch_fast(met[far].tolist(), add_special_tokens=False)
            others = pa.array([np.array(x.ids, dtype=self.kind).tobytes() for x in got], pa.binary())
            ids = pa.concat_arrays([self.cut_up(met[~far].tolist()), others])
            place = np.empty(len(met), np.int32)
            place[np.concatenate([np.flatnonzero(~far), np.flatnonzero(far)])] = np.arange(len(met), dtype=np.int32)
            at = pa.array(place[at.to_numpy()])
        else:
            ids = self.cut_up(met.tolist())
        return joined(ids.take(at), np.cumsum(lists.value_lengths().to_numpy()))


def joined(parts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Binary values, each of which is all parts from where the one before ends up to its own end."""
    starts = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    offsets = np.ascontiguousarray(starts[np.concatenate([[0], ends])])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), parts.buffers()[2]])


_coders: dict[str, ChunkCoder] = {}
_proofs: dict[tuple[str, str], object] = {}


def coder(path: str, whole: dict[str, int]) -> ChunkCoder:
    """This worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path, whole)
    return _coders[path]


def proof(spark, path: str):
    """The whole tokens of a vocabulary file, proved once an application in a task of its own and sent to all workers."""
    key = spark.sparkContext.applicationId, path
    if key not in _proofs:

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    whole = prove_whole(path)
                    yield pa.RecordBatch.from_arrays([pa.array(whole, pa.string()), pa.array(whole.values(), pa.int32())], names=["token", "id"])

        rows = spark.range(1, numPartitions=1).mapInArrow(prove, "token string, id int").collect()
        _proofs[key] = spark.sparkContext.broadcast({r["token"]: r["id"] for r in rows})
    return _proofs[key]
