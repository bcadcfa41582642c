"""Encoding whole texts with a public tokenizer file, each distinct piece once.

A text is cut into pieces that no token crosses, so the ids of the whole are those of its
pieces in turn. Pieces repeat, so their ids come from a table that holds a bounded number of
them and outlives a task; where it is full, the half that came most often stays. The rest is
array work. The cut is exact for both kinds of files here: white-space-dropping tokenizers are
cut at spaces, tabs and line ends, byte-level ones by their own pre-tokenization pattern.

``ColumnEncoder`` gives ids of whole columns and finds their distinct pieces in Arrow;
``PieceEncoder`` gives offsets as well.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and ids that a table with offsets holds before its rarer half goes, and the length
#: from which pieces are not kept after their text.
MOST_PIECES, MOST_IDS, MOST_CHARS = 200_000, 1 << 21, 64
#: Pieces that a table of a column encoder holds.
MOST_WORDS = 200_000
#: Letters of the Latin blocks, whose lower case is one letter (all but U+0130), and the marks
#: that may stand behind them.
LATIN, MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+", ",.;:!?"


def public_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at ``at`` and hold ``n`` entries, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - n), n)


class ColumnEncoder:
    """Ids of columns of text for a white-space-dropping tokenizer.

    The table is an Arrow array of pieces beside arrays of their ids, a few MB in all. If the
    file lower-cases and marks word ends, A-Z are lowered first; letters with one mark behind
    them count as letters and mark, and new words of letters are encoded many at a time, as each
    ends with exactly one token of the word-end kind.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = self.tokenizer.to_str()  # searched, not parsed: the vocabulary would be held twice
        found = regex.search(r'"end_of_word_suffix":\s*"([^"]+)"', file)
        self.shares = bool(found) and '"Lowercase"' in file
        if self.shares:
            suffix = found[1]
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
            marks = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS]
            self.marks = np.array([x[0] for x in marks], np.int32)
            self.shares = all(len(x) == 1 for x in marks)
        #: What begins the strings that a text may hold for special tokens, which aren't lowered.
        self.special = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.n, self.at, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the half that came most often, and no long pieces."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: MOST_WORDS // 2])
        keep = keep[pc.less_equal(pc.binary_length(self.known), MOST_CHARS).to_numpy(zero_copy_only=False)[keep]]
        self.flat = self.flat[gathered(self.at[keep], self.n[keep].astype(np.int64))]
        self.known, self.n, self.seen = self.known.take(pa.array(keep)), self.n[keep], self.seen[keep] // 2
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n

    def learn(self, new: pa.Array) -> np.ndarray:
        """Encode distinct pieces and add them to the table; returns their places in it."""
        n = np.zeros(len(new), np.int64)
        words = pc.match_substring_regex(new, f"^{LATIN}$").to_numpy(zero_copy_only=False) if self.shares else np.zeros(len(new), bool)
        parts: list[np.ndarray] = []
        for flags, together in ((words, 500), (~words, 1)):
            where = np.flatnonzero(flags)
            own = new.take(pa.array(where)).to_pylist()
            lines = [" ".join(own[k : k + together]) for k in range(0, len(own), together)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
            each = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter(chain.from_iterable(got), np.int32, int(each.sum()))
            if together > 1 and len(own):
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(own) or ends[-1] != len(ids):
                    raise ValueError("a word of letters must end with one word-end token")
                each = np.diff(ends, prepend=0)
            n[where] = each
            parts.append(ids)
        order = np.append(np.flatnonzero(words), np.flatnonzero(~words))
        n = n[order]
        self.at = np.append(self.at, len(self.flat) + np.cumsum(n) - n)
        self.n, self.seen = np.append(self.n, n.astype(np.int32)), np.append(self.seen, np.zeros(len(n), np.int64))
        self.flat = np.concatenate([self.flat, *parts])
        places = np.empty(len(new), np.int64)
        places[order] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        return places

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Place in the table of each of distinct pieces; what is new is learned."""
        own = pc.index_in(pieces, self.known)
        if own.null_count:
            places = self.learn(pieces.filter(pc.is_null(own)))
            own = own.fill_null(-1).to_numpy().astype(np.int64)
            own[own < 0] = places  # the table isn't hashed again for them
            return own
        return own.to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a column without nulls."""
        if len(self.known) > MOST_WORDS:
            self.trim()
        if self.shares and not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special):
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        found = lists.flatten().dictionary_encode()
        pieces, which = found.dictionary, found.indices.to_numpy()
        marked = np.zeros(len(pieces), bool)
        if self.shares:
            marked = pc.match_substring_regex(pieces, f"^{LATIN}[{MARKS}]$").to_numpy(zero_copy_only=False)
            own = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
            pieces_of, place = own.dictionary, own.indices.to_numpy()
        else:
            pieces_of, place = pieces, np.arange(len(pieces))
        number = self.numbers(pieces_of)[place]
        np.add.at(self.seen, number, np.bincount(which, minlength=len(number)))
        # ids of each distinct piece, its mark behind them
        plain = self.n[number].astype(np.int64)
        n = plain + marked
        at = np.cumsum(n) - n
        ids = np.zeros(int(n.sum()), np.int32)
        ids[gathered(at, plain)] = self.flat[gathered(self.at[number], plain)]
        if marked.any():
            mark = pc.index_in(pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1), pa.array(list(MARKS))).to_numpy()
            ids[(at + plain)[marked]] = self.marks[mark]
        n = n[which]
        upto = np.append(0, np.cumsum(n))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids[gathered(at[which], n)], upto[bounds[1:]] - upto[bounds[:-1]]


class _Table(dict):
    """Number of each piece; an unknown piece gets the next number and waits to be learned.
    ``size``: numbers given so far."""

    def __init__(self, pieces=()):
        super().__init__(zip(pieces, range(len(pieces)), strict=True))
        self.size, self.new = len(self), []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = self.size
        self.size = n + 1
        return n


class PieceEncoder:
    """Ids and their character spans. ``cut``: "space", or the pattern whose matches are the
    pieces of a text."""

    def __init__(self, path: str, cut: str = "space"):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if cut == "space":
            self.cut = lambda t: t.replace("\n", " ").replace("\t", " ").split(" ")
            self.gap = 1  # a dropped character stands between pieces
        else:
            self.cut, self.gap = regex.compile(cut).findall, 0
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.table = _Table()
        self.n = np.zeros(1 << 16, np.int32)  # ids of each piece
        self.at = np.zeros(1 << 16, np.int64)  # where they begin
        self.chars = np.zeros(1 << 16, np.int32)
        self.seen = np.zeros(1 << 16, np.int64)  # how often they came
        self.used, self.flat = 0, [np.zeros(1 << 18, np.int32) for _ in range(3)]

    def trim(self) -> None:
        """Keep the half that came most often."""
        number = np.fromiter(self.table.values(), np.int64, len(self.table))
        often = self.seen[number]
        keep = np.zeros(len(number), bool)
        keep[np.argsort(-often, kind="stable")[: max(1, min(MOST_PIECES, len(number)) // 2)]] = True
        names, number = list(compress(self.table, keep)), number[keep]
        where = gathered(self.at[number], self.n[number].astype(np.int64))
        self.flat, self.used = [np.append(x[where], np.int32(0)) for x in self.flat], len(where)
        self.n, self.chars, self.seen = self.n[number], self.chars[number], often[keep] // 2
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n
        self.table = _Table(names)

    def reserve(self, pieces: int, ids: int) -> None:
        """Room for so many pieces and ids."""
        while pieces > len(self.n):
            self.n, self.at, self.chars, self.seen = (np.append(x, np.zeros_like(x)) for x in (self.n, self.at, self.chars, self.seen))
        while ids > len(self.flat[0]):
            self.flat = [np.append(x, np.zeros_like(x)) for x in self.flat]

    def learn(self) -> None:
        """Encode the pieces that wait; long ones hardly come again and aren't kept by name."""
        pieces, self.table.new = self.table.new, []
        first, last = self.table.size - len(pieces), self.table.size
        for at in range(0, len(pieces), 50_000):
            some = pieces[at : at + 50_000]
            got = self.tokenizer.encode_batch(some, add_special_tokens=False)
            ids = [e.ids for e in got]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            end = self.used + int(n.sum())
            self.reserve(last, end)
            own = slice(first + at, first + at + len(some))
            self.n[own], self.at[own] = n, self.used + np.cumsum(n) - n
            self.chars[own] = np.fromiter(map(len, some), np.int64, len(some))
            self.flat[0][self.used : end] = np.fromiter(chain.from_iterable(ids), np.int32, end - self.used)
            both = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in got)), np.int32, 2 * (end - self.used))
            self.flat[1][self.used : end], self.flat[2][self.used : end] = both[::2], both[1::2]
            self.used = end
        for piece in pieces:
            if len(piece) > MOST_CHARS:
                del self.table[piece]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and end of their characters in the text, number of ids of each text)."""
        if self.table.size > MOST_PIECES or self.used > MOST_IDS:
            self.trim()
        cut = [self.cut(t) for t in texts]
        in_text = np.fromiter(map(len, cut), np.int64, len(cut))
        pieces = np.fromiter(map(self.table.__getitem__, chain.from_iterable(cut)), np.int64, int(in_text.sum()))
        self.learn()
        if len(pieces):
            self.seen[: self.table.size] += np.bincount(pieces, minlength=self.table.size)
        n = self.n[pieces].astype(np.int64)
        where = gathered(self.at[pieces], n)
        upto, bounds = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(in_text))
        places = np.append(0, np.cumsum(self.chars[pieces].astype(np.int64) + self.gap))
        move = np.repeat(places[:-1] - np.repeat(places[bounds[:-1]], in_text), n)
        return self.flat[0][where], self.flat[1][where] + move, self.flat[2][where] + move, upto[bounds[1:]] - upto[bounds[:-1]]


_encoders: dict[tuple[str, str | None], ColumnEncoder | PieceEncoder] = {}


def encoder(path: str, cut: str | None = None) -> ColumnEncoder | PieceEncoder:
    """The encoder of this Python process for a file; with offsets if ``cut`` is given."""
    key = path, cut
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, cut) if cut else ColumnEncoder(path)
    return _encoders[key]
