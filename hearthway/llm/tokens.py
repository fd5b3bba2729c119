"""Token ids of whole tables, encoding each distinct word of a batch once."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from hearthway.llm.shared import worker_latest

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Words longer than this are encoded each time and not remembered.
LONGEST_KEPT = 48
KEPT_WORDS = 150_000


class Encoder:
    """Encodes with one tokenizer file.

    Byte-level BPE never joins a character that is not white space with white space behind it,
    so a text is cut there and each distinct piece is encoded once. With a rank file of the
    same vocabulary the pieces are encoded by that; the first batch is held against the tokenizer.
    """

    def __init__(self, path: str, ranks_path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("=u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("=u4")
        self.known: dict[bytes, bytes] = {}
        self.checked = ranks_path is None
        self.ranks = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranks = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.checked:
            self.checked = True
            some = [x for x in texts if len(x) < 2000][:5]
            if any(not np.array_equal(np.asarray(self.plain(x.decode()), self.kind), y) for x, y in zip(some, self.encode(some))):
                raise ValueError("the rank file does not belong to the tokenizer")
        special = [any(s in x for s in self.specials) for x in texts]
        data = b"".join(texts)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cuts = _cuts(np.frombuffer(data, np.uint8), starts[starts < len(data)])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = self._distinct(coded.dictionary.to_pylist())
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        where = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[where]
        first = (np.cumsum(sizes) - sizes)[where]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        out = flat[np.repeat(first - (stops - counts), counts) + np.arange(total)]
        edges = np.concatenate([[0], stops])
        low = edges[np.searchsorted(cuts, starts)]
        high = edges[np.searchsorted(cuts, ends)]
        return [np.asarray(self.plain(texts[k].decode()), self.kind) if special[k] else out[low[k] : high[k]] for k in range(len(texts))]

    def _distinct(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        found = [known.get(x) for x in pieces]
        missing = [k for k, x in enumerate(found) if x is None]
        if self.ranks is not None:
            fresh = (self.ranks.encode_ordinary(pieces[k].decode()) for k in missing)
        else:
            fresh = (x.ids for x in self.tokenizer.encode_batch([pieces[k].decode() for k in missing], add_special_tokens=False))
        for k, ids in zip(missing, fresh):
            found[k] = array(self.kind.char, ids).tobytes()
            if len(pieces[k]) <= LONGEST_KEPT:
                known[pieces[k]] = found[k]
        return found


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start: at texts, and at white space behind a character that is none."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = _WHITE[data]
    cut = np.zeros(len(data), bool)
    np.greater(white[1:], white[:-1], out=cut[1:])
    wide = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    if len(wide):
        one, two, three = data[wide - 1], data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        space = (two == 0xC2) & np.isin(one, (0x85, 0xA0))
        space |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        space |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | np.isin(one, (0xA8, 0xA9, 0xAF)))
        space |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        space |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
        cut[wide[space]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    """The encoder of a tokenizer file, kept by a Python worker from task to task."""
    return worker_latest("encoder", f"{path} {ranks_path}", lambda: Encoder(path, ranks_path))
