"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A piece (what the pre-tokenizer leaves together) is read symbol by symbol. For every end position the
encoding of the prefix up to it has exactly one last token: the one token ending there whose own merges leave it
whole and which is a lasting neighbour of the last token of the prefix before it (two tokens are lasting
neighbours if merging their symbols gives those two tokens again). Each position thus points back by one token.

Lookahead. Whether a merge (a, b) is made depends on b's symbols and on what an earlier merge could have done to b's
end: taken it together with what follows. Going through the merge list by rank, this bounds for every token how many
symbols behind its end can matter; the largest bound is the merge list's sufficient lookahead. Tokens that end that
far before the last symbol read are stable: they are emitted and forgotten. Memory is the lookahead and a few token
lengths, not the piece; texts are encoded, hashed and decoded in stretches.

Decoding. `Decoder` is a state machine fed with ids: for byte-level vocabularies it carries the unfinished bytes of
a character from one call to the next; for vocabularies without a decoder it joins the tokens' strings by blanks,
as the library does.

Defined results: null and empty texts have no tokens; the special tokens' literal strings in a text are their ids,
as in the library; repeated rows give repeated rows; other columns are kept out. Pieces may have any length.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.chunks import MARKS, Chunks, gather
from spanloom.llm.common import map_texts

#: Pieces of chunks that aren't words, of which the ids are remembered; results don't depend on it.
PIECES = 40_000
#: Pairs of tokens of which it is remembered whether they are lasting neighbours.
PAIRS = 300_000
#: Moves of the automaton that are remembered.
MOVES = 300_000
SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encoder of one vocabulary file of the tokenizers library: BPE over bytes, with an optional end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        norms = spec["normalizer"] or {}
        kinds = {n["type"] for n in norms.get("normalizers", [norms])}
        self.nfc, self.lowercase = "NFC" in kinds, "Lowercase" in kinds
        pre = next(p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split")
        if not pre["invert"] or pre["behavior"] != "Removed":
            raise ValueError("only a pre-tokenizer that keeps the matches of its pattern is supported")
        self.pattern = regex.compile(pre["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.literals = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Tokens that the merges build from their own symbols: by whether they end a piece, then by their symbols.
        self.whole: tuple[dict[str, str], dict[str, str]] = ({}, {})
        for t in self.ids:
            if t not in self.special and self.merged(self.split(t)) == [t]:
                self.whole[self.length(t) < len(t)]["".join(self.split(t)).removesuffix(self.suffix)] = t
        #: The beginnings of all those: states of the automaton that finds the tokens ending at a symbol.
        self.heads = {t[:i] for tokens in self.whole for t in tokens for i in range(len(t) + 1)}
        #: Symbols of the longest token that can come out.
        self.longest = max([1, *map(len, self.whole[0]), *map(len, self.whole[1])])
        self.lookahead = self.sufficient_lookahead()
        # By a state and a symbol, the next state and the tokens that end there; made when they are met. By a token,
        # whether those before it last; nothing before it always does.
        self._moves: tuple[dict[str, tuple], dict[str, tuple]] = ({}, {})
        self._after: dict[str, dict[str, bool]] = {t: {"": True} for tokens in self.whole for t in tokens.values()}
        self._pairs = 0

    def length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix) if self.suffix else token)

    def sufficient_lookahead(self) -> int:
        """So many symbols behind a token's end can decide whether it is one; what comes later can't."""
        taken: dict[str, int] = {}  # by token: as far behind its end as the merges so far, with it on the left, look
        formed: dict[str, int] = {}  # by token: as far behind its end as its own making looks
        for a, b in sorted(self.ranks, key=self.ranks.__getitem__):
            ends = bool(self.suffix) and b.endswith(self.suffix)  # nothing follows in the piece
            beyond = 0 if ends else max(taken.get(b, 0), formed.get(b, 0))
            formed[a + b] = max(formed.get(a + b, 0), beyond)
            taken[a] = max(taken.get(a, 0), self.length(b) + beyond)
        return max([1, *taken.values(), *formed.values()])

    def split(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix) if self.suffix else token
        ended = body != token
        return [*body[:-1], body[-1] + self.suffix * ended] if body else [token]

    def merged(self, parts: list[str]) -> list[str]:
        """The merge list applied to a few symbols."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def lasting(self, a: str, b: str) -> bool:
        if (known := self._after[b].get(a)) is None:
            if self._pairs > PAIRS:
                self._pairs = 0
                for before in self._after.values():
                    before.clear()
                    before[""] = True
            self._pairs += 1
            known = self._after[b][a] = self.merged(self.split(a) + self.split(b)) == [a, b]
        return known

    def _move(self, key: str, ended: bool) -> tuple[str, tuple]:
        """The state after a state and a symbol (key), and the length, the token and its memory of all that end there."""
        if len(moves := self._moves[ended]) > MOVES:
            moves.clear()
        whole, state = self.whole[ended], key
        while state not in self.heads:
            state = state[1:]
        ends = [(k, t, self._after[t]) for k in range(1, len(state) + 1) if (t := whole.get(state[-k:]))]
        if not ends:
            raise ValueError(f"no token ends at {key!r}")
        moves[key] = state, tuple(ends)
        return moves[key]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece, each as soon as it is stable. The last symbol comes with the suffix, the others without."""
        last = [""]  # of each prefix from the last stable position on, its last token; the first entry's is emitted
        size = [0]
        states, held = [""], max(self.lookahead, self.longest)
        most = held + 4 * self.longest
        for symbol in symbols:
            self._read(states, symbol[0], len(symbol) > 1, last, size)
            del states[0]
            if len(last) > most:
                stable = len(last) - 1
                while stable > len(last) - 1 - held:
                    stable -= size[stable]
                yield from self._chain(last, size, stable)
                del last[:stable], size[:stable]
        yield from self._chain(last, size, len(last) - 1)

    def _read(self, states: list[str], symbols: str, ended: bool, last: list[str], size: list[int]) -> None:
        """Reads symbols (ended: the piece's last one) and adds each prefix's state, last token and its length."""
        moves, state = self._moves[ended], states[-1]
        for symbol in symbols:
            key = state + symbol
            state, ends = moves.get(key) or self._move(key, ended)
            for k, token, after in ends:
                before = last[-k]
                ok = after.get(before)
                if self.lasting(before, token) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends at {key!r}")
            states.append(state)
            last.append(token)
            size.append(k)

    @staticmethod
    def _chain(last: list[str], size: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def piece(self, text: str) -> Iterator[int]:
        """Ids of a piece; a long one's symbols are made as they are read."""
        if len(text) <= 64:
            return map(self.ids.__getitem__, next(self.words([text])))
        byte = (b for c in text for b in c.encode("utf-8"))
        symbols = map(self.symbols.__getitem__, byte)
        return map(self.ids.__getitem__, self.stream(self._ended(symbols) if self.suffix else symbols))

    def words(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Tokens of each of many pieces. What one begins with as the one before it isn't read again."""
        states, last, size, before, ended = [""], [""], [0], "", self._moves[True]
        for word in words:
            symbols = self.short(word)
            cut, n = len(symbols) - bool(self.suffix), 0
            for a, b in zip(before, symbols[:cut]):
                if a != b:
                    break
                n += 1
            del states[n + 1 :], last[n + 1 :], size[n + 1 :]
            self._read(states, symbols[n:cut], False, last, size)
            before, end, out = symbols[:cut], cut, []
            if self.suffix:
                key, end = states[-1] + symbols[cut], len(symbols)
                for k, token, after in (ended.get(key) or self._move(key, True))[1]:
                    ok = after.get(last[-k])
                    if self.lasting(last[-k], token) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no token ends at {key!r}")
                out.append(token)
                end -= k
            while end > 0:
                out.append(last[end])
                end -= size[end]
            yield out[::-1]

    def short(self, text: str) -> str:
        """A piece's symbols."""
        return text if text.isascii() and text.isalpha() else "".join(map(self.symbols.__getitem__, text.encode("utf-8")))

    def _ended(self, symbols: Iterator[str]) -> Iterator[str]:
        held = next(symbols)
        for s in symbols:
            yield held
            held = s
        yield held + self.suffix

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lowercase:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return text


class Encoder(Chunks):
    """A transducer over chunks (what is between blanks), each distinct one read once; words together, sorted."""

    def __init__(self, path: str):
        self.of = Transducer(path)
        self.pieces: dict[str, bytes] = {}
        # where a run of letters and one of marks are always pieces, words with marks behind need no pattern
        parts = r"|[\p{L}]+|" in self.of.pattern.pattern and self.of.pattern.findall("é" + MARKS) == ["é", MARKS]
        super().__init__(self.of.lowercase and all("<|" in x for x in self.of.special), parts)

    def normal(self, word: str) -> str:
        return self.of.normal(word)

    def learn(self, keys: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order of their letters, so that one goes on where its beginning is the last one's."""
        texts, where = keys.to_pylist(), np.flatnonzero(plain)
        words = sorted(zip((w if (w := texts[i]).isascii() and w.islower() else self.of.normal(w) for i in where), where.tolist()))
        sizes, tokens, rest = np.zeros(len(texts), np.int64), [], np.flatnonzero(~plain)
        at = np.concatenate([np.array([i for _, i in words], np.int64), rest])
        long = []
        for found in self.of.words(w for w, _ in words):
            tokens += found
            long.append(len(found))
        others = [self._chunk(texts[i]) for i in rest]
        sizes[at] = long + [len(ids) // 4 for ids in others]
        flat = np.concatenate([np.fromiter(map(self.of.ids.__getitem__, tokens), "<u4", len(tokens)), np.frombuffer(b"".join(others), "<u4")])
        starts = np.zeros(len(texts), np.int64)
        starts[at] = np.cumsum(sizes[at]) - sizes[at]
        return sizes, gather(flat, starts, sizes)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.fromiter(self.of.piece(piece), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) > PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _plain_text(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.of.pattern.findall(self.of.normal(text))))

    def _chunk(self, chunk: str) -> bytes:
        if self.of.literals and self.of.literals.search(chunk):
            parts = enumerate(self.of.literals.split(chunk))
            return b"".join(self.of.special[x].to_bytes(4, "little") if i % 2 else self._plain_text(x) for i, x in parts)
        return self._plain_text(chunk)

    def cut(self, text: str | None, size: int = 1 << 16) -> Iterator[str]:
        """The text, about `size` characters at a time. No piece crosses a blank."""
        text, at = text or "", 0
        while at < len(text):
            end = len(text)
            if end - at > size and (blank := SPACE.search(text, at + size)):
                end = blank.end()
            yield text[at:end] if end - at < len(text) else text
            at = end

    def stretches(self, text: str | None, size: int = 1 << 16) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, about `size` characters at a time."""
        for part in self.cut(text, size):
            yield from self.encode_many([part])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stretches(text))


class Decoder:
    """Incremental: text(ids) may be called for one stretch of ids after another, then end()."""

    def __init__(self, of: Transducer, byte_level: bool = False):
        self.strings, self.byte_level, self.begun = of.strings, byte_level, False
        self.bytes = of.bytes
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def text(self, ids: Iterable[int]) -> str:
        if self.byte_level:
            return self.utf8.decode(bytes(self.bytes[c] for i in ids for c in self.strings[i]))
        out = " ".join(map(self.strings.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun |= bool(out)
        return out

    def end(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_rows(docs: DataFrame, path: str, keep_ids: bool = True, rows: int = 512) -> DataFrame:
    """doc_id, ids (binary, if kept), n_tokens, ids_sha256, decoded_sha256 of every row; no shuffle. `rows` at a time."""

    def run(texts: list[str]) -> list[list]:
        enc, begun = encoder(path), []
        rows = [[Decoder(enc.of), hashlib.sha256(), hashlib.sha256(), 0, []] for _ in texts]

        def parts() -> Iterator[str]:
            for row, t in zip(rows, texts):
                for part in enc.cut(t):
                    begun.append(row)
                    yield part

        for at, ids in enumerate(enc.encode_many(parts())):
            dec, own, decoded, n, held = row = begun[at]
            own.update(ids)
            decoded.update(dec.text(np.frombuffer(ids, "<u4").tolist()).encode("utf-8"))
            row[3] = n + len(ids) // 4
            if keep_ids:
                held.append(ids)
        out = []
        for dec, own, decoded, n, held in rows:
            decoded.update(dec.end().encode("utf-8"))
            out.append((*([b"".join(held)] if keep_ids else []), n, own.hexdigest(), decoded.hexdigest()))
        return list(zip(*out))

    fields = ["ids binary"] * keep_ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, ", ".join(fields), at_once=rows)


def digests(docs: DataFrame, path: str) -> DataFrame:
    return encode_rows(docs, path, keep_ids=False)
