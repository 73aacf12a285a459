"""Byte-level BPE encoding and decoding.

Encoding a piece of text (what the pre-tokenizer splits off) needs no merge loop. An Aho-Corasick
automaton over the vocabulary finds the longest token that starts at each byte. The encoder takes
longest tokens from the left; a token is accepted only if it is compatible with the one before it,
that is, if BPE would leave the boundary between the two standing. Otherwise it tries the next
shorter token that is a prefix, and where none is left it drops the token before and marks the
position as a dead end, so that each position is left behind once and the work is linear. A
sequence all of whose neighbours are compatible is exactly what the merges give.

Compatibility of (a, b) follows from the merge ranks along the right edge of a's merge tree and the
left edge of b's: the boundary falls if some merge across it has a lower rank than those that would
use up its two symbols first. Answers are kept in a table as pairs come up.

Words repeat, so what was found for a chunk of text is kept. The chunks of a batch that are not known
are encoded together: all their pieces take a token each in one step of numpy arrays. A piece that
reaches a dead end, or is long, is encoded by itself.

Decoding gathers bytes through an offset table of all tokens.

Nulls count as empty texts. The vocabulary (a few MB, fixed) is read from ``path`` once in each
Python worker, so the file must be on every machine. Rows are encoded in batches whose size does not
change the results; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from specdrift.llm.io import extended
from specdrift.llm.textnum import sliced, with_columns

#: Fixed pattern of the byte-level pre-tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks of text in a generation of a worker's memory.
MEMORY = 120_000
#: Pieces that take tokens together, those so few that they go on alone, and the bytes or characters from which a piece or a chunk is long.
TOGETHER, FEW, LONG = 16_384, 16, 64
#: Pairs of tokens whose compatibility the table holds, as a power of two.
_PAIR_BITS = 20
_NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory:
    """What was found for short strings. Of two generations the older one is forgotten whenever the younger
    is full, so what keeps coming up stays, and no more than 2 * ``MEMORY`` strings are held."""

    def __init__(self):
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def put(self, found: dict[str, str]) -> None:
        if len(self.young) + len(found) > MEMORY:
            self.old, self.young = self.young, {}
        self.young.update(islice(found.items(), MEMORY))


class Vocabulary:
    """Tokens, merge ranks and the tables that encoding and decoding look things up in."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, back = data["model"], _byte_alphabet()
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.ids = ids
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for b, i in ids.items():
            self.tokens[i] = b
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.merge: dict[tuple[int, int], int] = {}
        made_by: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = ids[as_bytes(a)], ids[as_bytes(b)]
            self.merge.setdefault((a, b), rank)
            made_by.setdefault(ids[self.tokens[a] + self.tokens[b]], (rank, a, b))
        self.right_edge = [self._edge(i, made_by, 2) for i in range(size)]
        self.left_edge = [self._edge(i, made_by, 1) for i in range(size)]
        # tokens of one and two bytes are in tables, where 256 stands for the end of a piece
        self.automaton = ahocorasick.Automaton()
        self.single, self.double = np.full(257, -1, np.int32), np.full(257 * 257, -1, np.int32)
        for b, i in ids.items():
            if len(b) > 2:
                self.automaton.add_word(b.decode("latin-1"), i)
            elif len(b) == 2:
                self.double[b[0] * 257 + b[1]] = i
            else:
                self.single[list(b)] = i
        self.automaton.make_automaton()
        self.shorter = [next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1) for t in self.tokens]
        self.compatible: dict[int, bool] = {}
        self.pairs = np.full(1 << _PAIR_BITS, -1, np.int64)  # the pair last seen in each slot
        self.pair_fits = np.zeros(1 << _PAIR_BITS, bool)
        self.sizes = [len(t) for t in self.tokens]
        self.decimals = [str(i) for i in range(size)]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.next_shorter = np.array(self.shorter, np.int64)
        self.digits = np.array([len(d) for d in self.decimals], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.splitter = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memory = _Memory()  # of chunks, by what follows their space

    @staticmethod
    def _edge(token: int, made_by: dict, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that uses it up) along an edge of the merge tree, byte first."""
        chain, used = [], _NEVER
        while True:
            chain.append((token, used))
            if token not in made_by:
                return chain[::-1]
            used, token = made_by[token][0], made_by[token][side]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = self._boundary_stands(a, b)
        return known

    def _boundary_stands(self, a: int, b: int) -> bool:
        left, right, i, j = self.right_edge[a], self.left_edge[b], 0, 0
        while True:
            x, x_used = left[i]
            y, y_used = right[j]
            rank = self.merge.get((x, y), _NEVER)
            # equal ranks: the same pair twice in a row, and the one further left merges first
            if rank < x_used and rank <= y_used and rank != _NEVER:
                return False
            if x_used == y_used == _NEVER:
                return True
            if x_used <= y_used:
                i += 1
                j += x_used == y_used
            else:
                j += 1

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None and self._reachable(whole):
            return [whole]
        n, sizes = len(data), self.sizes
        longest = self.longest([data]).tolist()
        compatible, shorter = self.compatible, self.shorter
        out: list[int] = []
        dead: bytearray | None = None
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if dead is None or not dead[end]:
                    if last < 0:
                        break
                    fits = compatible.get(last << 32 | token)
                    if fits or (fits is None and self.fits(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at = token, end
                token = longest[at] if at < n else -1
            else:
                if dead is None:
                    dead = bytearray(n + 1)
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= sizes[token]
                token = shorter[token]
        return out

    def longest(self, pieces: list[bytes]) -> np.ndarray:
        """The longest token that starts at each byte of the pieces, or -1; there is one -1 after each piece."""
        # no token has a character past Latin-1, so none is found across two pieces
        text = "".join([p.decode("latin-1") + "\u0100" for p in pieces])
        codes = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int32)
        found = self.single[codes]
        two = self.double[codes[:-1] * 257 + codes[1:]]
        found[:-1] = np.where(two >= 0, two, found[:-1])
        # ends ascend, so the last token of a start is its longest
        matches = chain.from_iterable(self.automaton.iter(text)) if self.automaton else iter(())
        while len(some := np.fromiter(islice(matches, 1_000_000), np.int64)):
            found[some[::2] + 1 - self.length[some[1::2]]] = some[1::2]
        return found

    def _reachable(self, token: int) -> bool:
        """Whether the merges give the token for its own bytes: its two parts never part company."""
        data = self.tokens[token]
        return len(data) == 1 or len(self.left_edge[token]) > 1

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs; a token with none before it (-1) always fits."""
        key = a * len(self.tokens) + b
        slot = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        found = self.pair_fits[slot]
        new = np.flatnonzero((self.pairs[slot] != key) & (a >= 0))
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            found[new] = np.array([self._boundary_stands(*divmod(k, len(self.tokens))) for k in pairs.tolist()], bool)[which]
            self.pairs[slot[new]] = key[new]
            self.pair_fits[slot[new]] = found[new]
        found[a < 0] = True
        return found

    def many_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece after the other, and the number of ids of each."""
        found = [self._together(at, [utf8(p) for p in pieces[at : at + TOGETHER]]) for at in range(0, len(pieces), TOGETHER)]
        rows, tokens = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return tokens, np.bincount(rows, minlength=len(pieces))

    def _together(self, first: int, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the piece, id) in order, the pieces numbered from ``first`` on."""
        sizes = np.array([len(p) for p in pieces])
        alone = [np.flatnonzero(sizes >= LONG)]
        row = np.flatnonzero(sizes < LONG)
        longest = self.longest([pieces[i] for i in row.tolist()])
        end = np.zeros(len(pieces), np.int64)
        end[row] = np.cumsum(sizes[row] + 1) - 1
        at = end[row] - sizes[row]
        token, last, depth = longest[at].astype(np.int64), np.full(len(row), -1), np.zeros(len(row), np.int64)
        taken = np.full((len(pieces), LONG + 1), -1, np.int32)  # by piece; the first column stands for no token
        dead = np.zeros(len(longest), bool)
        # as in ``piece``, each in turn drops the token before, takes its token, or turns to a shorter one
        while len(row) > FEW:
            stuck = np.flatnonzero(token < 0)
            if len(stuck):
                dropped = last[stuck]
                dead[at[stuck]] = True
                taken[row[stuck], depth[stuck]] = -1
                depth[stuck] -= 1
                at[stuck] -= self.length[dropped]
                last[stuck] = taken[row[stuck], depth[stuck]]
                token[stuck] = self.next_shorter[dropped]
            go = np.flatnonzero(token >= 0)
            to = at[go] + self.length[token[go]]
            fits = ~dead[to] & self.fit(last[go], token[go])
            good, shorter = go[fits], go[~fits]
            depth[good] += 1
            last[good], at[good] = token[good], to[fits]
            taken[row[good], depth[good]] = token[good]
            token[good] = longest[at[good]]
            token[shorter] = self.next_shorter[token[shorter]]
            lost = (token < 0) & (depth == 0)
            alone.append(row[lost])
            left = (at < end[row]) & ~lost
            row, at, last, token, depth = (x[left] for x in (row, at, last, token, depth))
        alone.append(row)
        again = np.concatenate(alone)
        taken[again] = -1
        ids = [self.piece(pieces[i]) for i in again.tolist()]
        rows, column = np.nonzero(taken >= 0)
        tokens = taken[rows, column].astype(np.int64)
        if len(again):
            rows = np.concatenate([rows, np.repeat(again, [len(x) for x in ids])])
            order = np.argsort(rows, kind="stable")
            rows, tokens = rows[order], np.concatenate([tokens, np.fromiter(chain.from_iterable(ids), np.int64)])[order]
        return rows + first, tokens

    def chunks(self, texts: list[str]) -> list[str]:
        """Ids of chunks of text (none empty), as decimals joined by commas."""
        if not texts:
            return []
        number: dict[str, int] = {}
        of, counts = [], []
        for t in texts:
            plain = _PLAIN.fullmatch(t)
            pieces = [p for p in plain.groups() if p] if plain else self.splitter.findall(t)
            of += [number.setdefault(p, len(number)) for p in pieces]
            counts.append(len(pieces))
        tokens, length = self.many_pieces(list(number))
        start = np.cumsum(length) - length
        size = length[of]
        ends = np.cumsum(size)
        ids = tokens[np.repeat(start[of] - ends + size, size) + np.arange(ends[-1])]
        decimals = ",".join([self.decimals[i] for i in ids.tolist()])
        commas = np.cumsum(self.digits[ids] + 1)[ends[np.cumsum(counts) - 1] - 1].tolist()
        return [decimals[a : b - 1] for a, b in zip([0, *commas[:-1]], commas, strict=True)]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, as an array and as decimals joined by commas."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of texts, as arrays and as decimals joined by commas."""
        parts: list = []
        ends, heads, gaps, words = [], [], [], []
        for text in texts:
            at = 0
            for m in self.specials.finditer(text) if self.specials else ():
                self._plain(text[at : m.start()], parts, heads, gaps, words)
                parts.append(str(self.special[m[0]]))
                at = m.end()
            self._plain(text[at:] if at else text, parts, heads, gaps, words)
            ends.append(len(parts))
        known = dict.fromkeys(words)
        known = dict(zip(known, map(self.memory.old.get, known), strict=True))
        new = [w for w, found in known.items() if found is None]
        made = self.chunks([*[text for _, text in heads], *[" " + w for w in new]])
        known.update(zip(new, made[len(heads) :], strict=True))
        for (i, _), found in zip(heads, made, strict=False):
            parts[i] = found
        for i, w in zip(gaps, words, strict=True):
            parts[i] = known[w]
        for w in [w for w in new if len(w) >= LONG or w[-1].isspace()]:
            del known[w]
        self.memory.put(known)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            decimals = ",".join(parts[a:b])
            yield np.fromstring(decimals, np.int32, sep=",") if decimals else np.empty(0, np.int32), decimals

    def _plain(self, text: str, parts: list, heads: list, gaps: list, words: list) -> None:
        """Adds what is known of a text's chunks to ``parts``. A space between two visible characters always
        starts a piece, so a text can be cut before each of them; what follows the space repeats a lot and
        is looked up. ``gaps`` and ``words`` get the places and texts of what is not known."""
        if not text:
            return
        cut = text.split(" ")
        unknown = self._look_up(cut, parts)
        missing = [cut[i] for i in unknown]
        # the memory holds nothing with white space at an end, so every odd space is beside a missing part
        if _ODD_SPACE.search(" ".join(missing)):
            del parts[len(parts) - len(cut) :]
            cut = _CUT.split(text)
            unknown = self._look_up(cut, parts)
            missing = [cut[i] for i in unknown]
        base = len(parts) - len(cut)
        heads.append((base, missing[0]))
        gaps += [base + i for i in unknown[1:]]
        words += missing[1:]

    def _look_up(self, cut: list[str], parts: list) -> list[int]:
        """Adds what the young memory holds to ``parts``, and tells where it has nothing. Both ends may have white
        space beside them and are always told."""
        found = list(map(self.memory.young.get, cut))
        found[0] = found[-1] = None
        parts += found
        return [i for i, known in enumerate(found) if known is None]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, with bytes that are not UTF-8 replaced."""
        if not len(ids):
            return ""
        length = self.length[ids]
        ends = np.cumsum(length)
        where = np.repeat(self.offset[ids] - ends + length, length) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode("utf-8", "replace")


#: A space with white space beside it, or at either end; and one between visible characters.
_ODD_SPACE = re.compile(r" (?:\s|$)|\s |^ ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters and then ASCII marks without an apostrophe: at most two pieces, these.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded_sha256: str | None = None) -> DataFrame:
    """``docs`` with an array<int> column ``ids``, and, where it is named, the SHA-256 of the text that they
    decode to: a check in the same pass, so that a worker holds one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in sliced(batches, text):
            found = [ids for ids, _ in vocab.encode_all([t or "" for t in batch.column(text).to_pylist()])]
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            made = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)]), pa.int32()))}
            if decoded_sha256:
                made[decoded_sha256] = pa.array([hashlib.sha256(vocab.decode(f).encode()).hexdigest() for f in found], pa.string())
            yield with_columns(batch, made)

    kept = docs.drop(ids, *[decoded_sha256] if decoded_sha256 else [])
    return kept.mapInArrow(run, extended(kept.schema, f"`{ids}` array<int>" + (f", `{decoded_sha256}` string" if decoded_sha256 else "")))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a string column ``text`` from the array<int> column ``ids`` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            found = [vocab.decode(np.array(i or [], np.int64)) for i in batch.column(ids).to_pylist()]
            yield with_columns(batch, {text: pa.array(found, pa.string())})

    kept = docs.drop(text)
    return kept.mapInArrow(run, extended(kept.schema, f"`{text}` string"))


def digest_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoding
    and decoding in one pass, for round-trip checks that need not move the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in sliced(batches, text):
            n, ids_sha, text_sha = [], [], []
            for ids, decimals in vocab.encode_all([t or "" for t in batch.column(text).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                text_sha.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield with_columns(
                batch.drop_columns([text]),
                {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())},
            )

    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = docs.drop(*[c for c in made if c != text])
    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, extended(kept.drop(text).schema, ddl))
