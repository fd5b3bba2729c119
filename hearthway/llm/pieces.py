"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores of a BPE model drive an agenda: the best-scoring merge of neighbours goes first,
leftmost among equals. Dropout skips a candidate merge when a keyed hash of the seed, the document, the word's place
in it and the candidate's place in the word falls below the rate. Every occurrence of a word thus has draws of its own,
one seed gives one segmentation, on any machine and however often a task is repeated, and another seed another.
All ids are pieces of the model, and decoding gives the text back exactly. Without dropout the ids are those of
the model's own encoder.

What becomes of an occurrence depends only on its word and on which candidates are dropped, so the ways through the
agenda are remembered as a trie: each occurrence draws along its word's path, and its first dropped candidate leads to the
path below. Occurrences without a remembered path run anew: those of one length side by side in numpy, where each step takes
the best candidate left in each of them; long words, words with characters without a piece and lengths that few
words have one by one. All have the same draws.

Characters without a piece become bytes. The mark U+2581, which stands for a space in pieces, is written as
bytes where it occurs in a text, so that it is not read as a space. Null and empty texts have no ids and
decode to an empty text. Very long words are handled in time n log n. Rows with null ids are encoded like others and
draw by their text; repeated rows have the same ids. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm.shared import as_texts, byte_chunks, mix64, worker_latest

SPACE = "▁"
#: Stands for U+2581 itself while a text is cut; a lone surrogate occurs in no text.
MARK = "\udc81"
LETTER, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", ".,!?%$&|*#;:\"')("
#: The longest words that run side by side, and the fewest and most of them.
LONGEST, FEWEST, MOST = 40, 12, 1 << 15
#: Paths through the agenda that a worker remembers before it starts anew, and how many occurrences of a step have to ask for one.
KEPT_PATHS, ASKED = 300_000, 4
#: The draw of a candidate: its place, mixed with the hash of the occurrence.
PLACE, TURN, WRAP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), (1 << 64) - 1
NEVER = np.int64(1 << 62)
#: Where the parts of a word of each length lie, by begin and stop, but for the stop.
ROWS = [np.array([a * n - a * (a + 1) // 2 - 1 for a in range(n)], np.int64) for n in range(LONGEST + 1)]


def units_of(pieces: dict) -> re.Pattern:
    """A pattern of words with the spaces before them, cut further where no piece crosses.

    Line ends stand apart if no piece holds one, and a mark behind a letter begins anew if no piece has the two.
    """
    all_pieces = "\n\n".join(pieces)
    line = "" if any("\n" in p for p in pieces) else "\n"
    marks = "".join(m for m in MARKS if not re.search(LETTER + re.escape(m), all_pieces))
    rest = f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|{line or SPACE}+"
    if not marks:
        return re.compile(rest)
    return re.compile(f"{SPACE}*[^{SPACE}{line}{re.escape(marks)}]*{LETTER}(?=[{re.escape(marks)}])|{rest}")


class Rows:
    """Rows of numbers of any length, one behind the other in an array that grows."""

    def __init__(self, dtype: type):
        self.flat, self.starts, self.count = np.zeros(1024, dtype), np.zeros(1024, np.int64), 0

    def add(self, row: list[int]) -> None:
        low = int(self.starts[self.count])
        if low + len(row) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (low + len(row)))
        if self.count + 2 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.flat[low : low + len(row)] = row
        self.count += 1
        self.starts[self.count] = low + len(row)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows in turn, and the length of each."""
        low = self.starts[which]
        sizes = self.starts[which + 1] - low
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Trie:
    """The characters of the pieces as a tree whose steps are looked up for many places at once.

    A step's key is its node and character. Keys that fall into one slot of a table move on to the next table.
    """

    def __init__(self, pieces: dict[str, int]):
        steps: dict[int, int] = {}
        ends = {}
        for piece, k in pieces.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = k
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.tables = []
        keys, nodes = np.array(list(steps), np.uint64), np.array(list(steps.values()), np.int64)
        while len(keys):
            factor, shift = np.uint64(PLACE[0] + 2 * len(self.tables) * TURN[0] & WRAP), np.uint64(63 - len(keys).bit_length())
            slot, first = np.unique(keys * factor >> shift, return_index=True)
            held, to = np.full(1 << 64 - int(shift), WRAP, np.uint64), np.full(1 << 64 - int(shift), -1, np.int64)
            held[slot], to[slot] = keys[first], nodes[first]
            self.tables.append((factor, shift, held, to))
            keys, nodes = np.delete(keys, first), np.delete(nodes, first)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, -1 where no piece goes on like that."""
        keys = node.astype(np.uint64) << np.uint64(21) | char
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for factor, shift, held, to in self.tables:
            slot = keys * factor >> shift
            there = held[slot]
            same = there == keys
            out[open_[same]] = to[slot[same]]
            # An empty slot was asked for by no key.
            on = ~same & (there != np.uint64(WRAP))
            open_, keys = open_[on], keys[on]
        return out


class Paths:
    """Ways through the agenda of words that were met: the candidates behind the last dropped one, and the ids at the end."""

    def __init__(self, merged: Callable):
        self.merged = merged
        self.known: dict[str, int] = {}
        self.next: dict[int, int] = {}
        self.path: list[tuple[str, tuple[int, ...], int]] = []
        self.places, self.ids = Rows(np.uint64), Rows(np.int32)

    def __len__(self) -> int:
        return len(self.path)

    def find(self, word: str, dropped: tuple[int, ...]) -> int:
        """The path of a word on which just these candidates, numbered in the order they turn up, are dropped."""
        places: list[int] = []

        def keeps(place: int) -> bool:
            places.append(place)
            return len(places) - 1 not in dropped

        ids = self.merged(word, keeps)
        behind = dropped[-1] + 1 if dropped else 0
        self.places.add(places[behind:])
        self.ids.add(ids)
        self.path.append((word, dropped, behind))
        return len(self.path) - 1

    def of(self, words: list[str], often: np.ndarray) -> np.ndarray:
        """The paths of these words without a dropped candidate; words without one that few ask for, or that are long, have -1."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero((out < 0) & (often >= ASKED)).tolist():
            if len(words[k]) <= LONGEST:
                out[k] = self.known[words[k]] = self.find(words[k], ())
        return out

    def below(self, asked: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The paths that leave a path (all but the last eight bits) at a candidate (the last eight)."""
        out = np.fromiter(map(self.next.get, asked.tolist(), repeat(-1)), np.int64, len(asked))
        for k in np.flatnonzero((out < 0) & (often >= ASKED)).tolist():
            word, dropped, behind = self.path[asked[k] >> 8]
            out[k] = self.next[int(asked[k])] = self.find(word, (*dropped, behind + int(asked[k] & 255)))
        return out


class PieceEncoder:
    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rate, self.seed = int(rate * (1 << 32)), seed
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                self.bytes_of.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (model.get_score(k), k)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no pieces for bytes, so it cannot encode every text")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("the model joins words, which are encoded one by one here")
        self.cut = units_of(self.pieces)
        # Places of pieces in the order of the agenda; equal scores have one place, so that the leftmost goes first.
        order = sorted({-score for score, _ in self.pieces.values()})
        place = {score: k for k, score in enumerate(order)}
        self.order = np.zeros(len(self.bytes_of), np.int64)
        for score, k in self.pieces.values():
            self.order[k] = place[-score] << 8
        self.trie = Trie({piece: k for piece, (_, k) in self.pieces.items()})
        self.paths = Paths(self.merged)

    def merged(self, unit: str, keeps: Callable[[int], bool] | None) -> list[int]:
        """Ids of one word with the spaces before it; `keeps` tells of each candidate, by its place, whether it stays."""
        symbols = list(unit)
        n = len(symbols)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        get, push, agenda = self.pieces.get, heapq.heappush, []
        pa, pb, pe = PLACE
        fresh = range(n - 1)
        while True:
            for a in fresh:
                b = after[a]
                if b < n and (found := get(symbols[a] + symbols[b])):
                    end = stop[b]
                    if keeps is None or keeps((a * pa + b * pb + end * pe) & WRAP):
                        push(agenda, (-found[0], a, b, end))
            while agenda:
                _, a, b, end = heapq.heappop(agenda)
                if symbols[a] and symbols[b] and after[a] == b and stop[b] == end:
                    break
            else:
                break
            symbols[a] += symbols[b]
            symbols[b] = ""
            stop[a] = end
            after[a] = b = after[b]
            if b < n:
                before[b] = a
            fresh = (before[a], a) if before[a] >= 0 else (a,)
        ids = []
        for s in symbols:
            if s in self.pieces:
                ids.append(self.pieces[s][1])
            elif s:
                ids += [self.byte_ids[x] for x in (SPACE if s == MARK else s).encode()]
        return ids

    def unit(self, unit: str, key: int = 0) -> list[int]:
        """Ids of one word with the spaces before it, for the occurrence with this hash."""
        rate, (ta, tb) = self.rate, TURN

        def keeps(place: int) -> bool:
            draw = ((key ^ place) * ta) & WRAP
            return ((draw ^ (draw >> 32)) * tb & WRAP) >> 32 >= rate

        return self.merged(unit, keeps if rate else None)

    def follow(self, where: np.ndarray, own: np.ndarray, units: list[str]) -> np.ndarray:
        """The remembered path that each occurrence takes, -1 if there is none.

        An occurrence goes along its path while no candidate is dropped; the first dropped one leads to the path below.
        Paths that enough of the occurrences ask for are found and remembered.
        """
        at = self.paths.of(units, np.bincount(where, minlength=len(units)))[where]
        live = np.flatnonzero(at >= 0)
        while len(live):
            path = at[live]
            places, sizes = self.paths.places.rows(path)
            draw = places ^ np.repeat(own[live], sizes)
            draw *= np.uint64(TURN[0])
            draw ^= draw >> np.uint64(32)
            draw *= np.uint64(TURN[1])
            hits = np.flatnonzero((draw >> np.uint64(32)) < np.uint64(self.rate))
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, hits, "right")
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            hits, owner = hits[first], owner[first]
            asked, back, often = np.unique(path[owner] << 8 | (hits - ends[owner] + sizes[owner]), return_inverse=True, return_counts=True)
            live = live[owner]
            at[live] = self.paths.below(asked, often)[back]
            live = live[at[live] >= 0]
        return at

    def held(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """What words of n characters hold: the ids of the pieces between all their places, -1 without one, and whether each character is a piece."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        table = np.full((len(words), n * (n + 1) // 2), -1, np.int32)
        word, a = np.divmod(np.arange(chars.size), n)
        node = np.zeros(chars.size, np.int64)
        for k in range(n):
            node = self.trie.step(node, chars[word, a + k])
            on = node >= 0
            table[word[on], ROWS[n][a[on]] + a[on] + k + 1] = self.trie.piece[node[on]]
            on &= a + k + 1 < n
            word, a, node = word[on], a[on], node[on]
        letters = np.arange(n)
        return table.ravel(), (table[:, ROWS[n] + letters + 1] >= 0).all(axis=1)

    def candidates(self, table: np.ndarray, n: int, base: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of candidates in the agenda; `NEVER` where there is no piece or it is dropped."""
        piece = table[base + ROWS[n][a] + end]
        out = self.order[piece] | a
        out[piece < 0] = NEVER
        if self.rate:
            draw = a.astype(np.uint64) * np.uint64(PLACE[0]) + b.astype(np.uint64) * np.uint64(PLACE[1]) + end.astype(np.uint64) * np.uint64(PLACE[2])
            draw ^= own
            draw *= np.uint64(TURN[0])
            draw ^= draw >> np.uint64(32)
            draw *= np.uint64(TURN[1])
            out[(draw >> np.uint64(32)) < np.uint64(self.rate)] = NEVER
        return out

    def side_by_side(self, table: np.ndarray, n: int, base: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of words of n characters in order: word, begin, stop. `table`, `base`: what the words hold, and where."""
        size = len(base)
        # Where the symbol that begins at a place stops (0: none begins), and where the one that stops there begins.
        stop = np.repeat(np.arange(1, n + 1)[:, None], size, 1)
        begin = np.repeat(np.arange(-1, n)[:, None], size, 1)
        ones = np.ones(size, np.int64)
        agenda = np.full((n, size), NEVER)
        for a in range(n - 1):
            agenda[a] = self.candidates(table, n, base, own, ones * a, ones * (a + 1), ones * (a + 2))
        live = np.arange(size)
        while len(live):
            best = agenda.min(axis=0)
            on = np.flatnonzero(best != NEVER)
            if len(on) < len(live):
                live, best, agenda, base, own = live[on], best[on], agenda[:, on], base[on], own[on]
            column = np.arange(len(live))
            a = best & 255
            b = stop[a, live]
            end = stop[b, live]
            stop[a, live], stop[b, live], begin[end, live] = end, 0, a
            agenda[a, column] = agenda[b, column] = NEVER
            some = np.flatnonzero(end < n)
            left, right = a[some], end[some]
            agenda[left, some] = self.candidates(table, n, base[some], own[some], left, right, stop[right, live[some]])
            some = np.flatnonzero(a > 0)
            left, right = begin[a[some], live[some]], a[some]
            agenda[left, some] = self.candidates(table, n, base[some], own[some], left, right, end[some])
        which, at = np.nonzero(stop.T)
        return which, at, stop[at, which]

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; `keys` are hashes of the documents."""
        split = [self.cut.findall(f"{SPACE}{x.replace(SPACE, MARK).replace(' ', SPACE)}") if x else [] for x in texts]
        words = list(chain.from_iterable(split))
        units = list(dict.fromkeys(words))
        where = np.fromiter(map(dict(zip(units, range(len(units)))).__getitem__, words), np.int64, len(words))
        sizes = np.array([len(x) for x in split], np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(len(where)) - np.repeat(ends - sizes, sizes)
        own = mix64(np.repeat(mix64(keys.astype(np.uint64) ^ np.uint64(self.seed & WRAP)), sizes) + place.astype(np.uint64))
        if len(self.paths) > KEPT_PATHS:
            self.paths = Paths(self.merged)
        counts = np.zeros(len(where), np.int64)
        done = []
        path = self.follow(where, own, units)
        on, rest = np.flatnonzero(path >= 0), np.flatnonzero(path < 0)
        if len(on):
            ids, counts[on] = self.paths.ids.rows(path[on])
            done.append((on, ids))
        # The others run anew.
        length = np.fromiter(map(len, units), np.int64, len(units))[where[rest]]
        length[length > LONGEST] = 0
        order = np.argsort(length, kind="stable")
        edges = np.searchsorted(length[order], np.arange(LONGEST + 2))
        order = rest[order]
        alone = [order[: edges[1]]]
        for n in range(1, LONGEST + 1):
            group = order[edges[n] : edges[n + 1]]
            if len(group) < FEWEST:
                alone.append(group)
                continue
            for low in range(0, len(group), MOST):
                some = group[low : low + MOST]
                mine, back = np.unique(where[some], return_inverse=True)
                table, whole = self.held([units[k] for k in mine.tolist()], n)
                alone.append(some[~whole[back]])
                some, back = some[whole[back]], back[whole[back]]
                base = back * (n * (n + 1) // 2)
                which, at, stop = self.side_by_side(table, n, base, own[some])
                counts[some] = np.bincount(which, minlength=len(some))
                done.append((some, table[base[which] + ROWS[n][at] + stop]))
        for k in np.concatenate(alone).tolist():
            ids = self.unit(units[where[k]], int(own[k]))
            counts[k] = len(ids)
            done.append((np.array([k]), ids))
        stops = np.cumsum(counts)
        out = np.empty(int(stops[-1]) if len(stops) else 0, np.int32)
        for some, ids in done:
            long = counts[some]
            after = np.cumsum(long)
            out[np.repeat(stops[some] - after, long) + np.arange(after[-1])] = ids
        edges = np.concatenate([[0], stops])
        return [out[edges[e - s] : edges[e]] for s, e in zip(sizes, ends)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts before the first word is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode()


def encode_pieces(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per document: id, n_ids, ids_crc32, decoded_chars, decoded_sha256 of the decoded ids, and the ids themselves."""
    narrow = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit(seed)).alias("_key"), F.col(text_col).alias("_text"))
    schema = T.StructType([narrow.schema.fields[0]]).add("n_ids", "long").add("ids_crc32", "long").add("decoded_chars", "long").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_latest("piece_encoder", f"{model} {rate} {seed}", lambda: PieceEncoder(model, rate, seed))
        for batch in batches:
            texts, keys = as_texts(batch.column(2)), batch.column(1).to_numpy()
            for some in byte_chunks(texts, 1 << 20):
                ids = own.encode(texts[some], keys[some])
                decoded = [own.decode(x) for x in ids]
                arrays = [
                    batch.column(0)[some.start : some.stop], pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([len(x) for x in decoded], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return narrow.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text of an array of ids; null ids give a null text."""
    schema = T.StructType([*rows.schema.fields]).add(text_col, "string")
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_latest("piece_decoder", model, lambda: PieceEncoder(model, 0.0, 0))
        for batch in batches:
            texts = [None if x is None else own.decode(np.asarray(x, np.int32)) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
