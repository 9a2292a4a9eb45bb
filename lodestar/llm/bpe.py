"""BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file of the tokenizers library (BPE with an end-of-word suffix) is read as data; the library itself is not
used here. White space parts a text into raw words, and no merge or pre-token crosses it, so each distinct raw word is
encoded once and kept in a bounded memo. The words that a batch lacks are normalised and parted into pre-tokens, whose
byte symbols go to one flat array; each round finds every pair's rank by binary search over the sorted pair keys,
takes the lowest of each pre-token and merges all its places at once.

Cases: a null text is an empty one; an empty text has no tokens (and decodes to an empty string); the added tokens of
the file are taken from the raw text first, as the library does; rows repeat and ids may be null without effect.
Letters and digits are told by the regex module's Unicode tables, which may be a version newer than the library's: the
two can differ on characters that the newest Unicode version added.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import pieces, plain_schema

#: Raw words in a memo; beyond it only those of the batch at hand stay.
MEMO = 400_000

# fixed values: the byte alphabet of byte-level vocabularies
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    out, more = [""] * 256, itertools.count(0x100)
    for b in range(256):
        out[b] = chr(b) if b in PRINTABLE else chr(next(more))
    return out


def lowered(text: str) -> str:
    """Lower case character by character (str.lower looks at a sigma's place in its word)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class BPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        number = range(max(self.tokens) + 1)
        self.texts = pa.array([b"%d" % i for i in number]), pa.array([self.tokens.get(i, "").encode() for i in number])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.lower = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": ""}]))
        #: whether a full stop or comma after a letter or digit is a pre-token of its own
        self.signs_apart = all(self.pattern.findall(a + b) == [a, b] for a in "a0z9" for b in ".,")
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of pre-tokens (not empty): those of unit i are ids[first[i]:first[i + 1]]."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        data = np.frombuffer(b"".join(units), np.uint8)
        ids, unit = self.inner[data], np.repeat(np.arange(len(units)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[data[ends]]
        none = len(self.keys)
        done_ids, done_unit = [], []
        while len(ids) > 1:
            pair = ids[:-1] << 20 | ids[1:]
            place = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            hit = (self.keys[place] == pair) & (unit[:-1] == unit[1:])
            rank = np.where(hit, self.rank[place], none)
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(np.append(rank, none), first)
            best = np.repeat(low, size)
            finished = best == none
            if finished.all():
                break
            take = np.flatnonzero(hit & (rank == best[:-1]))
            run = np.arange(len(take))
            begin = np.concatenate([[True], np.diff(take) != 1])
            take = take[(run - np.maximum.accumulate(np.where(begin, run, 0))) % 2 == 0]  # of overlapping places the first
            ids[take] = self.made[place[take]]
            done_ids.append(ids[finished])
            done_unit.append(unit[finished])
            stay = ~finished
            stay[take + 1] = False
            ids, unit = ids[stay], unit[stay]
        ids, unit = np.concatenate([*done_ids, ids]), np.concatenate([*done_unit, unit])
        order = np.argsort(unit, kind="stable")
        return ids[order], np.searchsorted(unit[order], np.arange(len(units) + 1))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of raw words (without white space)."""
        table: dict[bytes, int] = {}
        parts = []
        for w in words:
            if not w.isascii():
                w = unicodedata.normalize("NFC", w)
            parts.append([table.setdefault(p.encode(), len(table)) for p in self.pattern.findall(lowered(w))])
        if not table:
            return [[] for _ in words]
        ids, first = self.encode_units(list(table))
        ids, first = ids.tolist(), first.tolist()
        return [[i for p in ps for i in ids[first[p] : first[p + 1]]] for ps in parts]


class Units:
    """The raw words of texts, as numbers into the distinct ones: text i has number[first[i]:first[i + 1]].

    Parting at ASCII white space and finding the distinct words is Arrow's work; other white space stays inside a word,
    where the vocabularies' pattern skips it. An added token is a word of its own.
    """

    def __init__(self, texts: pa.Array, bpe: BPE) -> None:
        texts = texts.cast(pa.string()).fill_null("")
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        plain = not ((data == 0xCC) | (data == 0xCD)).any()  # no combining mark, to which case could matter
        for t in bpe.added:
            if pc.any(pc.match_substring(texts, t, ignore_case=True)).as_py():
                texts, plain = pc.replace_substring(texts, t, f" {t} "), False
        if plain and bpe.lower and bpe.signs_apart:  # fewer distinct words
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9])([.,])([ \n])", r"\1 \2\3")
        parts = pc.ascii_split_whitespace(texts)
        flat, first = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        first -= first[0] if len(first) else 0
        filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not filled.all():
            first = np.concatenate([[0], np.cumsum(filled)])[first]
            flat = flat.filter(pa.array(filled))
        coded = flat.dictionary_encode()
        self.first, self.number, self.words = first, coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def joined(self, values: list[bytes], counts: np.ndarray) -> list[bytes]:
        """For each text what its words have, joined by a space; words with count 0 have nothing to join."""
        number, first = self.number, self.first
        if not counts.all():
            keep = counts[number] > 0
            number, first = number[keep], np.concatenate([[0], np.cumsum(keep)])[first]
        taken = pa.array(values, pa.binary()).take(pa.array(number))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), taken)
        return pc.binary_join(lists, b" ").to_pylist()


class Memo:
    """The ids of raw words; bounded. encode gives the ids' bytes of many words at once."""

    def __init__(self, bpe: BPE, encode: Callable[[list[str]], list[bytes]] | None = None) -> None:
        self.bpe, self.kept = bpe, {}
        self.encode = encode or (lambda words: [np.array(ids, "<u4").tobytes() for ids in bpe.encode_words(words)])
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in bpe.added.items()}

    def ids(self, words: list[str]) -> list[bytes]:
        """Bytes of the 32-bit ids of distinct words."""
        kept = self.kept
        if len(kept) + len(words) > MEMO:
            self.kept = kept = {w: kept[w] for w in words if w in kept}
        lack = [w for w in words if w not in kept and w not in self.added]
        if lack:
            kept.update(zip(lack, self.encode(lack), strict=True))
        kept.update(self.added)
        return list(map(kept.__getitem__, words))


_MEMOS: dict[str, Memo] = {}


def digests(path: str, texts: list[str] | pa.Array) -> list[tuple[int, str, str]]:
    """(number of ids, sha256 of the decimal ids, sha256 of the decoded text) of each text."""
    if path not in _MEMOS:
        _MEMOS[path] = Memo(BPE(path))
    memo = _MEMOS[path]
    units = Units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), memo.bpe)
    data = memo.ids(units.words)
    counts = np.fromiter(map(len, data), np.int64, len(data)) // 4
    ids = np.frombuffer(b"".join(data), "<u4")
    first = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    decimal, plain = memo.bpe.texts
    words = [pc.binary_join(pa.ListArray.from_arrays(first, t.take(pa.array(ids))), b" ").to_pylist() for t in (decimal, plain)]
    total = np.concatenate([[0], np.cumsum(counts[units.number])])[units.first]
    sha = [[hashlib.sha256(x).hexdigest() for x in units.joined(w, counts)] for w in words]
    return list(zip(np.diff(total).tolist(), *sha, strict=True))


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text."""
    memo = Memo(bpe := BPE(path))
    units = Units(pa.array(texts, pa.string()), bpe)
    data = [np.frombuffer(d, "<u4").tolist() for d in memo.ids(units.words)]
    return [[i for w in units.number[a:b] for i in data[w]] for a, b in zip(units.first[:-1], units.first[1:], strict=True)]


def decode(path: str, ids: list[int]) -> str:
    tokens = BPE(path).tokens
    return " ".join(tokens[i] for i in ids)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's number of ids and the digests of its ids and of what they decode to. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 4 << 20):
            n, ids, decoded = zip(*digests(path, batch.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = plain_schema(f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
