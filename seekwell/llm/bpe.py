"""BPE encoding and decoding as streaming transducers.

Encoding.  Merge rules are applied in order of rank, so the tokens of two texts that share their first p symbols can
differ only near p: a rule (u, v) moves the point of difference to the left, past u, only if v begins at that point
in one of the two texts, that is if an earlier rule with left part x moved the point there and x stands at the left
edge of some derivation of v.  :func:`sufficient_lookahead` takes the longest such chain over the merge list, so a token that
ends at least that many symbols before the end of what has been read is stable and can be emitted; memory is bounded
by lookahead and block, whatever the length of a word.  No merge crosses a token boundary, so encoding goes on from
the last emitted token.

Texts pass through in pieces that end at white space; a word is read symbol by symbol, a block at a time, its end makes all of its
tokens stable, and short words are remembered.  Ids are hashed and decoded as they are emitted, so no list of a text's words or ids is held.

Decoding.  An incremental machine: each id becomes the bytes of its token, which an incremental UTF-8 state machine
turns into text; where the tokenizer has no decoder, tokens are joined by one space.

Defined cases: null text counts as empty; an empty text has no ids and decodes to an empty text; special tokens written
in a text become their ids; text of any length is processed in whole; null ids stay null; repeated rows each give a row; an empty table
gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read

#: White space as the tokenizer's patterns know it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
BLOCK, PIECE = 2048, 1 << 16
CACHE_WORDS = 800_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols that must follow a token before it can no longer change, from the merge list alone."""
    made: dict[str, list[str]] = {}  # token -> left parts of its rules
    length: dict[str, int] = {}
    size = lambda t: length.get(t, 1)
    for u, v in merges:
        made.setdefault(u + v, []).append(u)
        length[u + v] = max(length.get(u + v, 0), size(u) + size(v))
    edge_of: dict[str, frozenset[str]] = {}

    def left_edge(t: str) -> frozenset[str]:
        if t not in edge_of:
            edge_of[t] = frozenset([t]).union(*(left_edge(u) for u in made.get(t, [])))
        return edge_of[t]

    reach: dict[str, int] = {}  # left part -> how far to the left a rule with it has moved the point of difference
    longest = 1
    for u, v in merges:
        far = size(u) + max((reach.get(x, 0) for x in left_edge(v)), default=0)
        reach[u] = max(reach.get(u, 0), far)
        longest = max(longest, far)
    return longest


class Memory(dict):
    """Ids of runs: one that is not known is encoded; of ``most`` runs the older generation goes when the younger is full."""

    def __init__(self, encode, most: int = CACHE_WORDS):
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = self.encode(run)
        if len(run) <= 40:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids


class Transducer:
    """Encoder and decoder for one tokenizer file with a BPE model over byte letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pieces = [b" " + token[i].encode("utf-8") if i in token else b"" for i in range(max(token) + 1)]
        self.letters = byte_letters()
        import regex

        s = SPACE
        self.gap = regex.compile(f"[{s}]" if not any(c in s for t in self.special for c in t) else r"(?!)")
        self.run, self.controls = regex.compile(f"[^{s}]+"), re.compile("[\x1c-\x1f]")
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{s}\p{{L}}\p{{N}}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.raw = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.known = Memory(self.chunk)

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, the lowest rank first and the leftmost of equal ones first."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, syms = self.rank, list(symbols)
        if n <= 24:  # short words: ranks of neighbours in a list, renewed only around each merge
            far, get = 1 << 60, rank.get
            ranks = [get(p, far) for p in zip(syms, syms[1:], strict=False)]
            while ranks:
                best = min(ranks)
                if best == far:
                    break
                at = ranks.index(best)
                syms[at] += syms.pop(at + 1)
                del ranks[at]
                if at:
                    ranks[at - 1] = get((syms[at - 1], syms[at]), far)
                if at < len(ranks):
                    ranks[at] = get((syms[at], syms[at + 1]), far)
            return syms
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(syms, syms[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or (syms[i], syms[j]) != p:
                continue
            syms[i] += syms[j]
            gone[j], nxt[i] = 1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (q := (syms[i], syms[nxt[i]])) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
            if prv[i] >= 0 and (q := (syms[prv[i]], syms[i])) in rank:
                heapq.heappush(heap, (rank[q], prv[i], q))
        return [s for s, g in zip(syms, gone, strict=True) if not g]

    def stream(self, blocks):
        """Tokens of one word from blocks of its symbols, each as soon as it is stable; no more than lookahead, a block and a token are held."""
        held = next(blocks)
        for some in blocks:
            if len(held) > self.lookahead:
                yield from self._stable(held)
            held += some
        yield from self.merged(held)  # the end of the word makes all stable

    def _stable(self, held: list[str]):
        limit, done = len(held) - self.lookahead, 0
        tail = self.suffix
        for t in self.merged(held):
            width = len(t) - (len(tail) if tail and t.endswith(tail) else 0)
            if done + width > limit:
                break
            done += width
            yield t
        del held[:done]

    def symbols(self, word: str, size: int = BLOCK):
        """Letters that stand for the bytes of a word, in blocks of ``size`` characters; the last one carries the end mark."""
        letters = self.letters
        for at in range(0, len(word), size):
            some = word[at : at + size]
            block = [*some] if some.isascii() and some.isprintable() else [letters[b] for b in some.encode("utf-8")]  # printable ASCII stands for itself
            if at + size >= len(word):
                block[-1] += self.suffix
            yield block

    def word(self, word: str) -> bytes:
        """Ids of one word of the split pattern, as little-endian 32-bit integers."""
        return b"".join([self.raw[t] for t in self.stream(self.symbols(word)) if t in self.raw])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        return self.word(chunk) if chunk.isascii() and chunk.isalpha() else b"".join([self.word(w) for w in self.split.findall(chunk)])

    def normal(self, text: str) -> str:
        """NFC, then lower case one character at a time; white space is left, since it only separates."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # only there does the case of a character depend on its neighbours
            return "".join([c.lower() for c in text])
        return text.lower()

    def pieces_of(self, text: str, size: int = PIECE):
        """A text in parts that end after white space, where nothing of one part depends on the next."""
        at = 0
        while len(text) - at > size:
            gap = self.gap.search(text, at + size)
            end = gap.end() if gap else len(text)
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def encode(self, text: str, size: int = PIECE):
        """Ids of a whole text as little-endian 32-bit integers, emitted part by part."""
        special, known = self.special, self.known.__getitem__
        for part in self.pieces_of(text, size):
            for span in self.specials.split(part) if self.specials else (part,):
                if span in special:
                    yield special[span].to_bytes(4, "little")
                    continue
                low = self.normal(span)
                # str.split() also splits at four control characters that the patterns take for ordinary symbols
                runs = low.split() if not self.controls.search(low) else self.run.findall(low)
                yield b"".join(map(known, runs))

    def decoder(self):
        """A function that takes ids as they come (None at the end) and gives the text that is complete."""
        machine, piece, first = codecs.getincrementaldecoder("utf-8")(), self.pieces, True

        def feed(ids: bytes | None) -> str:
            nonlocal first
            if ids is None:
                return machine.decode(b"", True)
            raw = b"".join([piece[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])
            if first and raw:  # no space before the first token
                raw, first = raw[1:], False
            return machine.decode(raw)

        return feed

    def decode(self, ids: bytes, block: int = 1 << 16):
        """Text of ids, in pieces."""
        feed = self.decoder()
        for at in range(0, len(ids), 4 * block):
            yield feed(ids[at : at + 4 * block])
        yield feed(None)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for each row; texts stay whole, rows stay apart."""
    path = path or tokenizer_path()

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n, ids_sha, text_sha, all_ids = [], [], [], []
                for text in part.column("text"):
                    ids_hash, text_hash, feed, size, kept = hashlib.sha256(), hashlib.sha256(), t.decoder(), 0, []
                    for ids in t.encode(text.as_py() or ""):
                        ids_hash.update(ids)
                        text_hash.update(feed(ids).encode("utf-8"))
                        size += len(ids) // 4
                        if with_ids:
                            kept.append(ids)
                    text_hash.update(feed(None).encode("utf-8"))
                    n.append(size)
                    ids_sha.append(ids_hash.hexdigest())
                    text_sha.append(text_hash.hexdigest())
                    all_ids.append(b"".join(kept))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (little-endian 32-bit integers)."""
    path = path or tokenizer_path()

    def run(batches):
        t = transducer(path)
        for batch in batches:
            texts = ["".join(t.decode(x.as_py())) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    return encode_documents(read(spark, sf_dir, "documents"))
