"""BPE encoding and decoding by tree concatenation.

A public tokenizer file is a parameter.  Text is cut at ASCII white space,
which no token of such a tokenizer crosses; every distinct chunk is normalised
and pre-tokenised by the library and looked up in a bounded cache afterwards.
A pre-token longer than ``leaf`` symbols is long unsplit text: it is halved
until the pieces are short, all leaves are encoded in one parallel call, and
neighbours are then joined level by level.  At a join a window of tokens of
both sides is encoded again and grows until its first and last token are
those of the sides.  A BPE sequence is the encoding of its text exactly if
each pair of neighbouring tokens is, so an agreeing window makes the whole
join exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .storage import small_batches

#: Longest run of symbols that is encoded in one piece.
LEAF = 256
#: Entries of each of the two generations of the cache of chunks, for each Python worker.
CACHE = 120_000
#: Bytes of chunks, ids and tokens from which on a generation is thrown away; one text's are held in any case.
CACHE_BYTES = 16 << 20
#: A chunk of its own that no plain chunk holds.
MARK = b"\x01 "
#: A full stop or comma that is a pre-token of its own.
STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeEncoder:
    """Exact BPE of one pre-token of any length."""

    def __init__(self, spec: dict, leaf: int = LEAF):
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.leaf = leaf
        self.inner = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.final = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.text_of = {i: t for t, i in vocab.items()}

    def _encode(self, pieces: list[tuple[str, bool]]) -> list[list[int]]:
        """Encodes pieces in parallel; the flag says whether a piece ends its word."""
        out: list[list[int]] = [[] for _ in pieces]
        for model, flag in ((self.inner, False), (self.final, True)):
            at = [i for i, (_, last) in enumerate(pieces) if last is flag]
            if at:
                for i, e in zip(at, model.encode_batch([pieces[i][0] for i in at], add_special_tokens=False), strict=True):
                    out[i] = e.ids
        return out

    def encode(self, word: str) -> list[int]:
        if len(word) <= self.leaf:
            return self._encode([(word, True)])[0]
        count = 1
        while len(word) > self.leaf * count:
            count *= 2
        bounds = [len(word) * i // count for i in range(count + 1)]
        level = self._encode([(word[a:b], b == len(word)) for a, b in zip(bounds, bounds[1:], strict=False)])
        while len(level) > 1:
            level = self._join_level(level)
        return level[0]

    def _text(self, ids: list[int], last: bool) -> str:
        text = "".join(self.text_of[i] for i in ids)
        return text[: -len(self.suffix)] if last and self.suffix else text

    def _join_level(self, level: list[list[int]]) -> list[list[int]]:
        """Joins neighbours two by two; all windows of a round are encoded in one call."""
        pairs = [(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        out: list[list[int] | None] = [None] * len(pairs)
        width = 2
        while any(x is None for x in out):
            open_ = [i for i, x in enumerate(out) if x is None]
            windows = []
            for i in open_:
                left, right = pairs[i]
                end = i == len(pairs) - 1 and width >= len(right)
                windows.append((self._text(left[-width:], False) + self._text(right[:width], end), end))
            for i, ids in zip(open_, self._encode(windows), strict=True):
                left, right = pairs[i]
                if (width >= len(left) or ids[0] == left[-width]) and (width >= len(right) or ids[-1] == right[width - 1]):
                    out[i] = left[:-width] + ids + right[width:]
            width *= 2
        return out  # type: ignore[return-value]


class Codec:
    """Encodes and decodes texts as the library does for the same file."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            specials = json.load(f)["added_tokens"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.path, self._tree = path, None
        self.specials = {t["content"]: t["id"] for t in specials}
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)))
        self.held = 0  # bytes of the young generation's entries
        self.leaf, self.size = leaf, cache
        self.token = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.id_text = {i: str(i) for i in self.token}
        [self.mark] = self.library.encode(MARK.decode(), add_special_tokens=False).ids
        self.apart = re.compile(b"|".join(map(re.escape, [MARK.strip(), *(x.encode() for x in self.specials)])))
        self.young: dict[bytes, tuple[int, str, str]] = {}  # chunk: number of tokens, ids, tokens
        self.old: dict[bytes, tuple[int, str, str]] = {}

    @property
    def tree(self) -> TreeEncoder:
        """Made when the first long pre-token is met, as it holds the model twice more."""
        if self._tree is None:
            with open(self.path, encoding="utf-8") as f:
                self._tree = TreeEncoder(json.load(f), self.leaf)
        return self._tree

    def _long(self, chunk: str) -> list[int]:
        """A chunk that may hold long pre-tokens, between special tokens."""
        ids: list[int] = []
        for text, special in self._split_specials(chunk):
            if special is not None:
                ids.append(special)
                continue
            normal = self.library.normalizer.normalize_str(text)
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                ids += self.tree.encode(word)
        return ids

    def _split_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at special tokens, the first and of those at one place the longest, in one pass."""
        done = 0
        for found in self.special.finditer(text) if self.specials else ():
            if found.start() > done:
                yield text[done : found.start()], None
            yield found.group(), self.specials[found.group()]
            done = found.end()
        if done < len(text):
            yield text[done:], None

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(self.id_text.__getitem__, ids)), " ".join(map(self.token.__getitem__, ids))

    def _encode(self, chunks: list[bytes]) -> None:
        """Puts chunks into the cache; plain ones are encoded in one call, with a mark after each."""
        plain = [c for c in chunks if len(c) <= self.leaf and not self.apart.search(c)]
        if plain:
            text = MARK.join([b" ".join((c, b"")) for c in plain]) + MARK
            ids = self.library.encode(text.decode(), add_special_tokens=False).ids
            at = 0
            for c in plain:
                to = ids.index(self.mark, at)
                self._keep(c, self._entry(ids[at:to]))
                at = to + 1
        if len(plain) < len(chunks):
            for c in set(chunks).difference(plain):
                self._keep(c, self._entry(self._long(c.decode())))

    def _keep(self, chunk: bytes, entry: tuple[int, str, str]) -> None:
        self.young[chunk] = entry
        self.held += len(chunk) + len(entry[1]) + len(entry[2])

    def _chunks(self, text: bytes) -> list[bytes]:
        """The text cut where no token crosses: at ASCII white space, and before a full stop or comma between a letter and white space."""
        if b"<|" not in text:
            text = text.lower()  # ASCII letters alone; a special token would have to stay as it is
        return STOP.sub(rb" \1", text).split()

    def encode_all(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """For each UTF-8 text: number of tokens, ids joined by a space, decoded text."""
        out = []
        for text in texts:
            if len(self.young) > self.size or self.held > CACHE_BYTES:
                self.old, self.young, self.held = self.young if self.held <= CACHE_BYTES else {}, {}, 0
            chunks = self._chunks(text)
            unseen = set(chunks).difference(self.young)
            if self.old:
                for c in [c for c in unseen if c in self.old]:
                    self.young[c] = self.old[c]
                    unseen.remove(c)
            if unseen:
                self._encode(list(unseen))
            parts = [p for p in map(self.young.__getitem__, chunks) if p[0]]
            if parts:
                counts, ids, tokens = zip(*parts, strict=True)
                out.append((sum(counts), " ".join(ids), " ".join(tokens)))
            else:
                out.append((0, "", ""))
        return out


_codecs: dict[tuple, Codec] = {}


def _codec(path: str, leaf: int) -> Codec:
    if (path, leaf) not in _codecs:
        _codecs[path, leaf] = Codec(path, leaf)
    return _codecs[path, leaf]


def encode_documents(docs: DataFrame, tokenizer: str, leaf: int = LEAF, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, token count and digests; with ``keep`` also ``ids`` and ``decoded``.

    A null text counts as empty: no tokens and the digests of the empty string.
    Repeated rows give repeated results, an empty table an empty one, other
    columns are not looked at.  ``tokenizer`` must be readable at the same
    place on every executor.  No shuffle; memory is bounded by one Arrow batch.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = codec.encode_all([(x or "").encode() for x in part.column("text").to_pylist()])
                cols = [part.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if keep else ""))
